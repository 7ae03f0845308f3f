"""duelframe: a PySpark-native analytics engine for head-to-head contest data."""
