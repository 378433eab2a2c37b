"""Sources and sinks: the testdata star schema mapped to raw traffic records,
JSON landing/ingest, parameterised range readers, table sinks and upsert."""
