"""The given relational tables read as ordered paths.

Suppliers with their lines by ship date, users with their events, and documents
with their stretches of words each play chromosomes with their genes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pathweave.functions.prefix import ordered_rank
from pathweave.session import materialise
from pathweave.sources.annotation import SCHEMAS, Annotation

# Fixed values of the mapping.
NUMBER_BITS = 32
UNASSIGNED_LINE = 7
NATIONS = 25
EVENTS_FROM = "2024-01-01 00:00:00"
EVENT_SECONDS = 60
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _typed(name: str, df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields])


def chromosome_id(key: Column) -> Column:
    """Ids of chromosomes are negative, those of genes are not, so the two never meet."""
    return -1 - _checked(key, 62)


def gene_id(key: Column, number: Column) -> Column:
    """The key above ``NUMBER_BITS`` bits of the gene's number on its chromosome."""
    return F.shiftleft(_checked(key, 62 - NUMBER_BITS), NUMBER_BITS).bitwiseOR(
        _checked(number, NUMBER_BITS)
    )


def _checked(value: Column, bits: int) -> Column:
    """``value``, or a failed job where it needs a sign or more bits."""
    message = F.concat(F.lit(f"no {bits}-bit number: "), value.cast("string"))
    fits = value.between(0, (1 << bits) - 1) | value.isNull()
    return F.when(fits, value.cast("long")).otherwise(F.raise_error(message).cast("long"))


def chromosome_name(column: str) -> Column:
    return F.replace(F.col(column), F.lit("#"), F.lit("."))


def _nations(spark: SparkSession, folder: str) -> DataFrame:
    return (
        table(spark, folder, "nation")
        .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_nationkey").alias("organism_id"),
            F.col("r_name").alias("genus"),
            F.col("n_name").alias("species"),
        )
    )


def line_genes(spark: SparkSession, folder: str, dense: bool = False) -> DataFrame:
    """One row per line: ``(suppkey, number, gene_id, fmin, fmax, strand, family)``.

    The family is the part, or with ``dense`` its brand and type; lines numbered 7
    have none.
    """
    return _with_places(_numbered_lines(spark, folder, dense))


def _with_places(lines: DataFrame) -> DataFrame:
    """With the columns that follow from others, which are not written."""
    fmin = F.col("number") * 1000
    return lines.select(
        "suppkey",
        "number",
        gene_id(F.col("suppkey"), F.col("number")).alias("gene_id"),
        fmin.alias("fmin"),
        (fmin + 100 + F.col("quantity")).alias("fmax"),
        "strand",
        "family",
    )


def _numbered_lines(spark: SparkSession, folder: str, dense: bool) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(*LINE_ORDER, "l_suppkey", "l_returnflag")
    ranked = ordered_rank(
        lines,
        ["l_suppkey"],
        LINE_ORDER,
        F.year("l_shipdate") * 12 + F.month("l_shipdate"),
        "number",
    )
    label = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    if dense:
        parts = table(spark, folder, "part").select(
            F.col("p_partkey").alias("l_partkey"),
            F.concat("p_brand", F.lit("|"), "p_type").alias("label"),
        )
        ranked = ranked.join(parts, "l_partkey", "left")
        label = F.col("label")
    return ranked.select(
        F.col("l_suppkey").alias("suppkey"),
        "number",
        F.col("l_quantity").cast("int").alias("quantity"),
        F.when(F.col("l_returnflag") == "R", -1).otherwise(1).alias("strand"),
        F.when(F.col("l_linenumber") != UNASSIGNED_LINE, label).alias("family"),
    )


def line_annotation(spark: SparkSession, folder: str, dense: bool = False) -> Annotation:
    """Suppliers as chromosomes, their nations as organisms."""
    genes = _with_places(materialise(_numbered_lines(spark, folder, dense), "line-genes"))
    suppliers = table(spark, folder, "supplier")
    chromosome = chromosome_id(F.col("suppkey"))
    nation_of = suppliers.select(
        F.col("s_suppkey").alias("suppkey"), F.col("s_nationkey").alias("organism_id"), "s_name"
    )
    gene_features = genes.join(nation_of, "suppkey").select(
        F.col("gene_id").alias("feature_id"),
        "organism_id",
        F.concat(F.lit("g"), F.col("gene_id").cast("string")).alias("name"),
        F.concat(F.lit("g"), F.col("gene_id").cast("string")).alias("uniquename"),
        F.lit(None).cast("int").alias("seqlen"),
    )
    lengths = genes.groupBy("suppkey").agg(F.max("fmax").alias("seqlen"))
    chromosome_features = lengths.join(nation_of, "suppkey").select(
        chromosome.alias("feature_id"),
        "organism_id",
        chromosome_name("s_name").alias("name"),
        F.col("s_name").alias("uniquename"),
        "seqlen",
    )
    parts = {
        "feature": _typed("feature", gene_features).unionByName(
            _typed("feature", chromosome_features)
        ),
        "featureloc": genes.select(
            F.col("gene_id").alias("featureloc_id"),
            F.col("gene_id").alias("feature_id"),
            chromosome.alias("srcfeature_id"),
            "fmin",
            "fmax",
            "strand",
        ),
        "gene_family_assignment": genes.filter("family IS NOT NULL").select(
            F.col("gene_id").alias("gene_family_assignment_id"),
            "gene_id",
            F.col("family").alias("family_label"),
        ),
        "gene_order": genes.select(
            F.col("gene_id").alias("gene_order_id"),
            chromosome.alias("chromosome_id"),
            "gene_id",
            "number",
        ),
        "organism": _nations(spark, folder),
    }
    return Annotation(**{name: _typed(name, df) for name, df in parts.items()})


def event_annotation(spark: SparkSession, folder: str) -> Annotation:
    """Users as chromosomes with their events in time order; few, dense families."""
    events = table(spark, folder, "events").select(
        _checked(F.col("event_id"), 62).alias("event_id"), "ts", "user_id", "event_type"
    )
    events = materialise(
        ordered_rank(
            events, ["user_id"], ["ts", "event_id"], F.date_trunc("month", "ts"), "number"
        ),
        "event-genes",
    )
    chromosome = chromosome_id(F.col("user_id"))
    nation = F.pmod("user_id", F.lit(NATIONS))
    seconds = F.unix_timestamp("ts") - F.unix_timestamp(F.lit(EVENTS_FROM).cast("timestamp"))
    event_name = F.concat(F.lit("e"), F.col("event_id").cast("string"))
    user_name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    event_features = events.select(
        F.col("event_id").alias("feature_id"),
        nation.alias("organism_id"),
        event_name.alias("name"),
        event_name.alias("uniquename"),
        F.lit(None).cast("int").alias("seqlen"),
    )
    user_features = (
        events.groupBy("user_id")
        .agg((F.max(seconds) + EVENT_SECONDS).alias("seqlen"))
        .select(
            chromosome.alias("feature_id"),
            nation.alias("organism_id"),
            user_name.alias("name"),
            user_name.alias("uniquename"),
            "seqlen",
        )
    )
    parts = {
        "feature": _typed("feature", event_features).unionByName(
            _typed("feature", user_features)
        ),
        "featureloc": events.select(
            F.col("event_id").alias("featureloc_id"),
            F.col("event_id").alias("feature_id"),
            chromosome.alias("srcfeature_id"),
            seconds.alias("fmin"),
            (seconds + EVENT_SECONDS).alias("fmax"),
            F.lit(1).alias("strand"),
        ),
        "gene_family_assignment": events.select(
            F.col("event_id").alias("gene_family_assignment_id"),
            F.col("event_id").alias("gene_id"),
            F.col("event_type").alias("family_label"),
        ),
        "gene_order": events.select(
            F.col("event_id").alias("gene_order_id"),
            chromosome.alias("chromosome_id"),
            F.col("event_id").alias("gene_id"),
            "number",
        ),
        "organism": _nations(spark, folder),
    }
    return Annotation(**{name: _typed(name, df) for name, df in parts.items()})


def word_positions(spark: SparkSession, folder: str, words: int = 3) -> DataFrame:
    """``(chromosome, pos, family)``: every stretch of ``words`` words of every document."""
    split = table(spark, folder, "documents").select(
        F.col("doc_id").alias("chromosome"), F.split("text", " ", -1).alias("words")
    )
    count = F.size("words") - (words - 1)
    columns = [f"w{i}" for i in range(words)]
    stretches = split.filter(F.size("words") >= words).select(
        "chromosome",
        *[F.slice("words", i + 1, count).alias(c) for i, c in enumerate(columns)],
    )
    return stretches.select(
        "chromosome", F.posexplode(F.arrays_zip(*columns)).alias("pos", "stretch")
    ).select(
        "chromosome", "pos", F.concat_ws(" ", *[f"stretch.{c}" for c in columns]).alias("family")
    )
