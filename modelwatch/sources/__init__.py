"""Tables on disk and the adapters of the test data."""
