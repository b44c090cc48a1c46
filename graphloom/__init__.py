"""graphloom: a PySpark-native engine for program graphs, transcripts and text corpora."""
