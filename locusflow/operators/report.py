"""Files of calls and coverage: headers, and lines with a column for each sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.operators import caller
from locusflow.operators.pileup import BASES, SITE
from locusflow.sources import sinks

# The names, numbers and types of the variant file's fields. The descriptions are this package's own.
FILTERS = [("LowQual", "The quality is too low")]
FORMATS = [("GT", "Genotype: 0/. for REF, ./i for the i-th ALT"), ("AB", "Observed base"), ("SO", "Strand of the read, + or -"), ("BP", "Chance that the base is right, from its quality")]
INFOS = [
    ("CM_AF", "A", "Float", "Frequency of each ALT by expectation-maximisation"),
    ("CM_CAF", "A", "Float", "Share of each ALT among the observations"),
    ("CM_AC", "A", "Integer", "Observations of each ALT"),
    ("CM_DP", "A", "Integer", "Observations of the position"),
    ("SB_REF", "A", "Integer", "Observations of REF on the forward and the reverse strand"),
    ("SB_ALT", "A", "Integer", "Observations of the ALTs on the forward and the reverse strand"),
    ("FS", "1", "Float", "Strand bias: phred-scaled p of Fisher's exact test"),
    ("BaseQRankSum", "1", "Float", "Phred-scaled p of the rank-sum test of base qualities, REF against ALTs"),
    ("SOR", "1", "Float", "Strand bias: odds ratio"),
    ("MQRankSum", "1", "Float", "Phred-scaled p of the rank-sum test of mapping qualities, REF against ALTs"),
    ("ReadPosRankSum", "1", "Float", "Phred-scaled p of the rank-sum test of places in the read, REF against ALTs"),
    ("QD", "1", "Float", "Quality by the depth of the ALTs"),
]


def variant_header(contigs: list[tuple[str, int]], samples: list[str], groups: list[str] = (), reference: str = "") -> list[str]:
    """The header lines of a variant file; groups add a field <group>_AF each."""
    named = lambda kind, n, text: f'##{kind}=<ID={n},Description="{text}">'
    return [
        "##fileformat=VCFv4.2", *[named("FILTER", n, text) for n, text in FILTERS], *[f'##FORMAT=<ID={n},Number=1,Type=String,Description="{text}">' for n, text in FORMATS],
        *[f'##INFO=<ID={n},Number={k},Type={kind},Description="{text}">' for n, k, kind, text in INFOS],
        *[f'##INFO=<ID={g}_AF,Number=A,Type=Float,Description="Frequency of each ALT in {g}">' for g in sorted(groups)],
        *[f"##contig=<ID={n},length={length},assembly={reference}>" for n, length in contigs], f"##reference=file://{reference}", "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples]),
    ]


def coverage_header() -> list[str]:
    """The header lines of a coverage file."""
    return ["##fileformat=CVGv1.0", "\t".join(["#CHROM", "POS", "REF", "Depth", *BASES, "Indels", "FS", "SOR", "Strand_Coverage(REF_FWD,REF_REV,ALT_FWD,ALT_REV)"])]


def variant_lines(obs: DataFrame, calls: DataFrame, groups: DataFrame, samples: DataFrame) -> DataFrame:
    """contig, pos and the line of every called position. Samples stand in the order of sample_idx; one without an observation has ./. there.

    groups: sample_idx and group. A position's line is as long as the list of samples, whatever is observed.
    """
    if calls.sparkSession.sparkContext.getCheckpointDir():
        calls = calls.checkpoint()  # in the shared folder, so that the model is fitted once and not for each of the joins below
    by_group = caller.call_groups(obs, calls, groups).where(F.size("afs") > 0)
    text = F.concat(F.col("group"), F.lit("_AF="), F.array_join(F.transform("afs", sinks.short), ","))
    listed = by_group.groupBy(*SITE).agg(F.transform(F.array_sort(F.collect_list(F.struct("group", text.alias("text")))), lambda x: x["text"]).alias("group_afs"))
    seen = caller.genotypes(obs.join(calls.select(*SITE), SITE, "left_semi"), calls)
    own = seen.select(*SITE, "sample_idx", caller.sample_text(F.col("gt"), F.col("base"), F.col("strand"), F.col("qual")).alias("text"))
    order = samples.agg(F.array_sort(F.collect_set("sample_idx")).alias("order"))  # one row: the header's list of samples
    places = F.broadcast(order.select(F.posexplode("order").alias("place", "sample_idx")))
    columns = own.join(places, "sample_idx", "left").groupBy(*SITE).agg(F.array_sort(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", "text")))).alias("texts"))
    # Only observations are looked at one by one: the samples between two of them are a run that is written at once.
    empty, after = "\t./.", lambda i: F.coalesce(F.get("texts", i)["place"], F.lit(-1))
    cells = F.flatten(F.transform("texts", lambda x, i: F.array(F.repeat(F.lit(empty), x["place"] - after(i - 1) - 1), F.lit("\t"), x["text"])))
    left = F.when(F.col("samples") == 0, "\t").otherwise(F.repeat(F.lit(empty), F.col("samples") - after(F.size("texts") - 1) - 1))
    rows = caller.info(obs, calls).join(listed, SITE, "left").join(columns, SITE).join(F.broadcast(order.select(F.size("order").alias("samples"))))
    fields = F.concat(sinks.variant_line(), F.when(F.size("group_afs") > 0, F.concat(F.lit(";"), F.array_join("group_afs", ";"))).otherwise(""))
    return rows.select(*SITE, F.concat_ws("", fields, F.lit("\tGT:AB:SO:BP"), cells, left).alias("line"))


def write(lines: DataFrame, header: list[str], path: str, contigs: list[str]) -> None:
    """One text dataset: the header's lines, then the lines by contig in the given order and by position.

    Part files in the order of their names are the whole file; the first of them begins with the header.
    """
    spark = lines.sparkSession
    top = spark.createDataFrame([(-1, i, x) for i, x in enumerate(header)], "nth bigint, pos bigint, value string")
    place = F.array_position(F.array(*map(F.lit, contigs)), F.col("contig")) - 1
    rows = lines.select(place.alias("nth"), F.col("pos").cast("bigint").alias("pos"), F.col("line").alias("value"))
    top.unionByName(rows).repartitionByRange("nth", "pos").sortWithinPartitions("nth", "pos").select("value").write.text(path)
