"""Common words with which run-together names are split, and words that mark unwanted sites."""

COMMON = """
about academy agency air all and animal app apps archive art arts auto baby bank bar beach best big bike bird
black blog blue board boat body book books box boy bread bridge bright business cafe camp car card care cars
center central church city class clean clinic club code coffee college color company computer cook cooking cool
country craft cup daily data day dental design digital direct doctor dog dream drive earth easy education energy
events express eye family fashion fast field film fine fire first fish fit fitness fly food football forest
forum friend fun furniture future game garden gift girl glass global gold golf good great green group guide hair
hand happy health heart help high hill history hobby home horse hospital hotel house idea info institute island
job journal journey kids king kitchen lab lady lake land language law leaf learn legal library life light line
link list little live local love magazine mail man map market math media medical metal mobile model modern moon
mother motor mountain movie museum music national nature net network new news night north ocean office old online
open orange paint paper park party pet phone photo pink place plan planet plant play poem point pool power press
print pro project public quality radio rain real recipe recipes record red research rest river road rock room
school science sea search secret sense service share shoes shop silver simple site sky small smart snow social
software solar song south space sport sports spring star stars station stone store story street student studio
style summer sun super surf table tea teach team tech technology test text the theater time tip tips today top
town toy train training travel tree trip turtle university urban video view village vision voice walk wall water
weather web wedding week west white wiki wild wind wine winter woman wood word work world yellow yoga you young
youth zone
""".split()

#: Weight of a word as a mark of an unwanted site when nothing is known yet; 1 is enough.
MARKS = {
    **dict.fromkeys("adult bet bets betting casino casinos gambling lottery malware phishing pills poker porn slots spam viagra xxx escort jackpot".split(), 1.0),
    **dict.fromkeys("ad ads track tracker tracking cheap free win winner loan loans payday sex farm click clicks bonus prize pharmacy meds".split(), 0.5),
}
