"""Training-data operators: every module takes and returns DataFrames; nothing outside this subpackage imports it."""
