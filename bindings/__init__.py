"""Test device: binds the operators to the generated tables. Column meanings here carry no domain truth."""
