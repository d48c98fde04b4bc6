"""What is sold and what is written about returns: two vocabularies that share no word.

Products name goods as a shop does, notes as a desk does that knows the kind of
goods only.  The kind leads from one to the other; no string does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import scalars as S

PRODUCTS = {
    "SHOES": ("Trailmark ridge runner 12", "Corvo suede loafers", "Pellham oxford brogue", "Dunewalk canvas espadrille"),
    "CLOTHES": ("Aster linen kurta", "Brightloom denim jacket", "Kestrel wool cardigan", "Ivory chiffon scarf"),
    "KITCHEN": ("Copperline saucepan 2L", "Stonehearth griddle 28cm", "Everkeen chef knife", "Lumi borosilicate jug"),
    "GADGETS": ("Orbita earbuds X200", "Voltio charger 65W", "Nimbus tablet 10in", "Pulsar soundbar mini"),
    "FOOD": ("Hillfarm basmati 5kg", "Sunpress mustard oil", "Redleaf assam tea", "Mornings muesli 750g"),
    "HOME": ("Oakridge bookshelf tall", "Restwell futon double", "Larkspur bar stool", "Hearthside woven rug"),
    "BOOKS": ("Harbour Lights paperback", "Quiet Algebra hardcover", "Atlas of Rivers", "Gridline notebook A5"),
    "BEAUTY": ("Glowroot serum 30ml", "Velvet Petal lipstick", "Cedarmist shampoo", "Saltstone body scrub"),
}
NOTES = {
    "SHOES": ("return - footwear did not fit", "pair of boots sent back, soles worn", "refund against footwear, heel came off"),
    "CLOTHES": ("return - garment sizing", "clothing returned, stitching open", "refund against apparel, faded after washing"),
    "KITCHEN": ("return - cookware dented", "utensil chipped in transit, refund approved", "refund against cooking goods, handle loose"),
    "GADGETS": ("return - electronics faulty", "appliance would not start", "refund against audio device, battery swollen"),
    "FOOD": ("return - groceries spoiled", "provisions expired at doorstep", "refund against pantry staples, seal leaking"),
    "HOME": ("return - furniture scratched", "furnishing leg cracked on arrival", "refund against household decor, screws absent"),
    "BOOKS": ("return - reading material misprinted", "publication had blank leaves", "refund against stationery, binding undone"),
    "BEAUTY": ("return - cosmetics irritated skin", "grooming item leaked", "refund against skincare, tube punctured"),
}
PAYMENT_NOTES = ("sale settled", "settled by acquirer", "sale credited")
CATEGORIES = tuple(PRODUCTS)


class Leak(ValueError):
    """A note has a word of a product."""


def frame(spark: SparkSession, texts: dict[str, tuple[str, ...]]) -> DataFrame:
    """(category, text) of one of the two vocabularies."""
    return spark.createDataFrame([(c, t) for c, some in texts.items() for t in some], "category string, text string")


def index(texts: DataFrame) -> DataFrame:
    """(token, category, text): the inverted index of (category, text)."""
    return texts.select("category", "text").distinct().select("category", "text", F.explode(S.tokens(F.col("text"))).alias("token"))


def _had(products: DataFrame) -> DataFrame:
    """(token, n_products, product): how many products have a word, and the least of them."""
    return index(products).groupBy("token").agg(F.count("*").alias("n_products"), F.min("text").alias("product"))


def leaks(products: DataFrame, notes: DataFrame) -> DataFrame:
    """(token, note_category, note, n_products, product): words of notes that products have too, each with how many and the least of them."""
    return index(notes).join(_had(products), "token").select("token", F.col("category").alias("note_category"), F.col("text").alias("note"), "n_products", "product")


def leak_counts(products: DataFrame, notes: DataFrame) -> DataFrame:
    """(token, note_category, n_notes, n_products, product): leaks by word and category of notes; words are counted before they meet the products', and no text goes with them."""
    said = index(notes).groupBy("token", F.col("category").alias("note_category")).agg(F.count("*").alias("n_notes"))
    return said.join(_had(products), "token").select("token", "note_category", "n_notes", "n_products", "product")


def silent(notes: DataFrame, products: DataFrame) -> DataFrame:
    """Notes that have no word of any product."""
    said = index(notes).join(index(products).select("token").distinct(), "token", "left_semi").select("category", "text").distinct()
    return notes.join(said, ["category", "text"], "left_anti")


def proven(products: DataFrame, notes: DataFrame) -> None:
    """Refuses two vocabularies that share a word, or of which one has categories that the other lacks."""
    if bad := leaks(products, notes).orderBy("token", "note").limit(5).collect():
        raise Leak("; ".join(f"{r.token!r} of the note {r.note!r} is in the product {r.product!r}" for r in bad))
    one, other = (t.select("category").distinct() for t in (products, notes))
    if lone := one.exceptAll(other).unionByName(other.exceptAll(one)).limit(5).collect():
        raise Leak("categories without products or notes: " + ", ".join(str(r[0]) for r in lone))


def categorised(df: DataFrame, column: str, texts: dict[str, tuple[str, ...]] = PRODUCTS, name: str = "category") -> DataFrame:
    """df with the category of the text in a column; null for a text that is not in the catalogue."""
    table = {t: c for c, some in texts.items() for t in some}
    return df.withColumn(name, S.lookup(F.col(column), table, None))


def by_category(requests: list) -> list[tuple[str | None, float]]:
    """A reader that knows the kinds: the one choice of the note's own category, if only one is."""
    kind = {t: c for texts in (PRODUCTS, NOTES) for c, some in texts.items() for t in some}
    out: list[tuple[str | None, float]] = []
    for note, choices in requests:
        hits = [label for label, text in choices if note in kind and kind.get(text) == kind[note]]
        out.append((hits[0], 0.9) if len(hits) == 1 else (None, 0.0))
    return out
