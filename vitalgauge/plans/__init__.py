"""The queries of this library with their SQL, and the whole status report."""
