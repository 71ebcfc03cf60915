"""Where points come from: adapters of tables and the synthetic generator. Files of any format come through ``spark.read``."""
