"""Sources and sinks: the test-data star schema, landing files, ingest."""
