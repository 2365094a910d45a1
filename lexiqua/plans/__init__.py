"""Physical patterns shared by the operators."""
