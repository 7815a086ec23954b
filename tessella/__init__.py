"""Tessella: a Spark-native analytics engine for catalogues of media files and the signals derived from them."""
