"""The SQL dialect: parser, compiler to Spark SQL, and the engine."""
