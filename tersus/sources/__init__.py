from tersus.sources.append import append, force_schema
from tersus.sources.catalog import TableSet
from tersus.sources.preview import preview
from tersus.sources.readers import RAW_STREAM_SCHEMA, TABLES, load_tables, read_raw, read_table
from tersus.sources.sinks import write_table, write_tables

__all__ = ["append", "force_schema", "TableSet", "preview", "RAW_STREAM_SCHEMA", "TABLES",
           "load_tables", "read_raw", "read_table", "write_table", "write_tables"]
