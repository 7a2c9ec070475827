from freightlens.sources.readers import (
    Tables, read_category_translation, read_csv_tables, read_parquet_tables,
    write_parquet_tables,
)
from freightlens.sources.schemas import SCHEMAS

__all__ = [
    "SCHEMAS", "Tables", "read_category_translation", "read_csv_tables", "read_parquet_tables",
    "write_parquet_tables",
]
