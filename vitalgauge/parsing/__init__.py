"""Reading source code: functions, classes, tokens.  No Spark in here."""
