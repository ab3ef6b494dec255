"""Column functions: every one maps columns to columns and stays inside whole-stage codegen."""
