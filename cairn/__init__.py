"""cairn: a PySpark-native engine for BEAM post-mortem dumps."""

ENGINE_VERSION = "1"
