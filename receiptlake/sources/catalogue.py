"""Product catalogue documents to rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATALOGUE = "products map<string, array<string>>"


def read_catalogue(df: DataFrame) -> DataFrame:
    """``json`` documents ``{"products": {category: [name, ...]}}`` to one row
    (category, pos, product) per name; other columns are kept."""
    others = [c for c in df.columns if c != "json"]
    return (
        df.select(*others, F.from_json("json", CATALOGUE)["products"].alias("products"))
        .select(*others, F.explode("products").alias("category", "names"))
        .select(*others, "category", F.posexplode("names").alias("pos", "product"))
    )
