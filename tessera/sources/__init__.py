"""Matrix sources and sinks: generators, Parquet/CSV, and matrices cut from tables."""
