"""Reading and writing frames."""

from .csv import CSVReader, read_csv, read_csv_text, to_csv
from .display import box
from .json import read_json, read_json_text, to_json

__all__ = ["CSVReader", "box", "read_csv", "read_csv_text", "read_json", "read_json_text", "to_csv", "to_json"]
