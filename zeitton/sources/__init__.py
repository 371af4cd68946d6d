"""Readers and writers. Parquet is the working format; the text formats are for exchange."""
