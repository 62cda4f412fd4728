"""Sources: delimited files of unknown separator, XML descriptors, JSON bundles, whole texts and blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessela.functions.text import fold

#: The first line of a large-file pointer, which stands in place of the data.
POINTER = "version https://git-lfs.github.com/spec/"


def _first_line(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    rows = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    return rows[0]["value"] if rows else ""


def sniff_separator(line: str) -> str:
    """The one of ; tab , that the header holds most often; a comma if none."""
    return max((";", "\t", ","), key=lambda s: (line.count(s), s == ","))


def slug(name: str) -> str:
    """A column name in lower case without accents, other signs as _."""
    import re
    import unicodedata

    plain = "".join(ch for ch in unicodedata.normalize("NFD", name.lower()) if not unicodedata.combining(ch))
    return re.sub(r"[^a-z0-9]+", "_", plain).strip("_")


def read_delimited(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """A file with a header, its separator found on the first line; all columns are strings, doubled quotes are quotes.

    Of columns with the same slug the later ones get a number.  An empty file gives no columns and no rows.
    """
    head = _first_line(spark, path, encoding)
    if not head.strip():
        return spark.createDataFrame([], "empty string").drop("empty")
    df = spark.read.csv(path, sep=sniff_separator(head), header=True, quote='"', escape='"', encoding=encoding, multiLine=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        s = slug(c) or "column"
        seen[s] = seen.get(s, 0) + 1
        names.append(s if seen[s] == 1 else f"{s}_{seen[s]}")
    return df.toDF(*names)


def resolve(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Columns by the first of their aliases that has a value in the row; null where none exists."""
    own = lambda names: [F.nullif(F.trim(F.col(n)), F.lit("")) for n in names if n in df.columns]
    return df.select(*[(F.coalesce(*own(names)) if own(names) else F.lit(None).cast("string")).alias(c) for c, names in aliases.items()])


def read_positional(spark: SparkSession, path: str, columns: dict[str, int], sep: str = ";", encoding: str = "ISO-8859-1") -> DataFrame:
    """A headed file of fixed column places (from 0)."""
    df = spark.read.csv(path, sep=sep, header=True, encoding=encoding)
    return df.select(*[F.col(f"`{df.columns[i]}`").alias(c) for c, i in columns.items()])


def read_descriptors(spark: SparkSession, path: str, row_tag: str = "DescriptorRecord") -> DataFrame:
    """(ui, name, tree_numbers, terms) of XML descriptor records."""
    schema = "DescriptorUI string, DescriptorName struct<String:string>, TreeNumberList struct<TreeNumber:array<string>>, ConceptList struct<Concept:array<struct<TermList:struct<Term:array<struct<String:string>>>>>>"
    df = spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)
    terms = F.flatten(F.transform("ConceptList.Concept", lambda c: F.transform(c["TermList"]["Term"], lambda t: t["String"])))
    return df.select(F.col("DescriptorUI").alias("ui"), F.col("DescriptorName.String").alias("name"), F.col("TreeNumberList.TreeNumber").alias("tree_numbers"), F.array_distinct(terms).alias("terms"))


def read_bundle(spark: SparkSession, path: str, schema: str, required: bool = True) -> DataFrame:
    """A JSON array, plain or gzipped.  A pointer file in its place is refused; a missing optional file is empty."""
    try:
        head = _first_line(spark, path)
    except Exception:  # noqa: BLE001
        if required:
            raise
        return spark.createDataFrame([], schema)
    if head.startswith(POINTER):
        raise ValueError(f"{path} is a pointer to large-file storage, not the data")
    return spark.read.schema(schema).json(path, multiLine=True)


def read_backup(spark: SparkSession, path: str, tables: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of one backup file, an object with an array for each."""
    doc = spark.read.schema(", ".join(f"`{t}` array<struct<{s}>>" for t, s in tables.items())).json(path, multiLine=True)
    return {t: doc.select(F.explode(F.col(t)).alias("r")).select("r.*") for t in tables}


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text or HTML files, as they are."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256, content) of any files."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def scan_summary(items: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, pages, chars, empty_pages, is_scanned): a document is scanned if it has hardly any text, or mostly empty pages."""
    pages = items.groupBy(doc, page).agg(F.coalesce(F.sum(F.length(F.trim(F.col(text)))), F.lit(0)).alias("n"))
    out = pages.groupBy(doc).agg(F.count("*").alias("pages"), F.sum("n").alias("chars"), F.count_if(F.col("n") == 0).alias("empty_pages"))
    return out.withColumn("is_scanned", (F.col("chars") < 50 * F.col("pages")) | (F.col("empty_pages") >= 0.7 * F.col("pages")))


def category_of(name: Column, rules: list[tuple[str, str]], other: str = "OUTROS") -> Column:
    """The first category one of whose words a display name, folded, contains; rules are (pattern, category) in order."""
    out = F.lit(other)
    for pattern, category in reversed(rules):
        out = F.when(fold(name).rlike(pattern), category).otherwise(out)
    return out


def tree_category(df: DataFrame, key: str, trees: str, ranked: list[tuple[str, str]]) -> DataFrame:
    """(key, category): of all tree numbers of a record the category whose prefix comes first in the ranking."""
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.lit(c).alias("c")) for i, (p, c) in enumerate(ranked)])
    hits = df.select(key, F.explode(trees).alias("t")).select(key, F.explode(F.filter(ranks, lambda r: F.startswith(F.col("t"), r["p"]))).alias("r"))
    return hits.groupBy(key).agg(F.min("r").alias("r")).select(key, F.col("r.c").alias("category"))


def flatten_dictionary(df: DataFrame, key: str, name: str, synonyms: str, code: str) -> DataFrame:
    """(norm, term, canonical, code): names and synonyms by normal form; the smallest key holds, a missing code is filled from the others."""
    rows = df.select(key, F.col(name).alias("canonical"), F.col(code).alias("code"), F.posexplode(F.concat(F.array(F.col(name)), F.coalesce(F.col(synonyms), F.array().cast("array<string>")))).alias("pos", "term"))
    rows = rows.withColumn("norm", F.trim(fold(F.col("term")))).where("norm != ''")
    first = F.min(F.struct(F.col(key).alias("k"), "pos", "term", "canonical"))
    return rows.groupBy("norm").agg(first.alias("f"), F.min_by("code", F.when(F.col("code").isNotNull(), F.col(key))).alias("code")).select("norm", "f.term", "f.canonical", "code")
