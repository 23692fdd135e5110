"""brightledger: business analytics over tables and text, written as Spark plans."""

from brightledger.session import get_spark, load_table, ship_package, work_folder

__all__ = ["get_spark", "load_table", "ship_package", "work_folder"]
