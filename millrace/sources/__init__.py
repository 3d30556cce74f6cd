"""Sources of facts: parquet tables and trees of C# files."""
