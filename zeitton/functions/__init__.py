"""Column expressions: everything here maps columns to columns, without shuffles or Python workers."""
