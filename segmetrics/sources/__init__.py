"""Input: fact-table schema, readers and writers, the test fixture, census enrichment."""
