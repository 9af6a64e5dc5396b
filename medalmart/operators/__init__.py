"""DataFrame operators: pure ``DataFrame -> DataFrame``, column names as parameters."""
