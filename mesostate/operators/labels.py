"""Conditions and groups from names, matching of names, pairs and sets of sessions.

All of it is column expressions and equi-joins.  The cuts are those of the recording names: a subject, a suffix for the
condition (``NOGO``, ``NG``, ``GO``), and words that say how a file was made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters with marks and the letters that they count as.
MARKED, PLAIN = "ÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇÝ", "AAAAAAEEEEIIIIOOOOOUUUUNCY"
#: What file names add to a subject.
FILE_WORDS = ("_SIN_CONTEXTO", "_EPO", "_LENGTHS.NPY", ".NPY")
#: Letters of a subject that a part of a name must begin with before it is looked for among all subjects.
HEAD = 3


def plain(name: Column) -> Column:
    """A name in capitals without marks on its letters."""
    return F.translate(F.upper(name), MARKED, PLAIN)


def condition(name: Column, fallback: Column | None = None) -> Column:
    """``GO`` or ``NOGO`` as it stands between underscores, else the fallback, else ``UNKNOWN``."""
    found = F.nullif(F.upper(F.regexp_extract(name, "(?i)_(NOGO|GO)_", 1)), F.lit(""))
    return F.coalesce(found, *([] if fallback is None else [fallback]), F.lit("UNKNOWN"))


def _without(name: Column, suffixes: list[tuple[str, int]]) -> Column:
    """The name less the last letters that the first fitting suffix names."""
    out = name
    for suffix, n in reversed(suffixes):
        out = F.when(F.endswith(name, F.lit(suffix)), F.substr(name, F.lit(1), F.length(name) - n)).otherwise(out)
    return out


def parse_name(name: Column, adults: list[str]) -> Column:
    """``struct<subject, grp, condition>`` of a file name by its suffix; the condition is ``GO`` without one."""
    clean = F.upper(name)
    for word in FILE_WORDS:
        clean = F.replace(clean, F.lit(word), F.lit(""))
    subject = _without(clean, [("NOGO", 4), ("NG", 2), ("GO", 2)])
    no_go = F.endswith(clean, F.lit("NOGO")) | F.endswith(clean, F.lit("NG"))
    adult = F.lit(False)
    for prefix in adults:
        adult = adult | F.startswith(subject, F.lit(prefix))
    return F.struct(subject.alias("subject"), F.when(adult, "ADULTO").otherwise("ADOLESCENTE").alias("grp"), F.when(no_go, "NOGO").otherwise("GO").alias("condition"))


def base_subject(subject: Column) -> Column:
    """A subject without the suffix of its condition; ``SINGO`` loses ``GO`` alone (LBL1)."""
    return _without(F.upper(subject), [("NOGO", 4), ("SINGO", 2), ("NGO", 3), ("NG", 2), ("GO", 2)])


def without_prefixes(df: DataFrame, name: str, prefixes: list[str]) -> DataFrame:
    """Rows whose name starts with none of the prefixes, whatever the marks and case."""
    hit = F.exists(F.array(*[F.lit(p) for p in prefixes]) if prefixes else F.array().cast("array<string>"), lambda p: F.startswith(plain(F.col(name)), plain(p)))
    return df.where(~hit)


def _parts(files: DataFrame, labels: DataFrame, file: str, subject: str, at: str) -> DataFrame:
    """``file, condition, _part``: the parts of each name that begin as some subject of their length does, each once.

    The beginnings that are sent to all tasks are no more than ``HEAD`` letters can be written in, for each length.
    """
    name, whole = F.upper(file), F.upper(subject)
    heads = labels.where(F.length(whole) > 0).select(F.left(whole, F.lit(HEAD)).alias("_head"), F.length(whole).alias("_n")).distinct()
    sizes = heads.agg(F.collect_set(F.length("_head")).alias("_sizes"))  # one row of up to HEAD lengths
    fitting = F.filter("_sizes", lambda n: n <= F.length(name))
    starts = F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), F.length(name) - n + 1), lambda a: F.struct(a.alias("_a"), F.substring(name, a, n).alias("_head")))))
    begun = files.select(file, at).crossJoin(F.broadcast(sizes)).select(file, at, F.inline(starts)).join(F.broadcast(heads), "_head")
    part = F.substring(name, F.col("_a"), F.col("_n"))
    return begun.where((F.length(part) == F.col("_n")) & (F.position(part, name) == F.col("_a"))).select(file, at, part.alias("_part"))


def match_names(files: DataFrame, labels: DataFrame, file: str = "file", subject: str = "subject", at: str = "condition") -> DataFrame:
    """``file, condition, subject, reason``: the label of the same condition whose subject stands in the file's name.

    The subject is null and the reason says why if none or several do.  Parts of a name that may be a subject meet the
    subjects by an equi-join, so labels and files are never crossed.
    """
    known = labels.select(F.upper(subject).alias("_part"), F.col(at), F.col(subject).alias("_subject"))
    hits = _parts(files, labels, file, subject, at).join(known, ["_part", at]).groupBy(file, at).agg(F.count(F.lit(1)).alias("n"), F.min("_subject").alias("s"))
    found = files.select(file, at).join(hits, [file, at], "left")
    n = F.coalesce("n", F.lit(0))
    return found.select(file, at, F.when(n == 1, F.col("s")).alias(subject), F.when(n == 0, "no match").when(n > 1, "several matches").alias("reason"))


def condition_pairs(sessions: DataFrame, base: str, at: str, session: str) -> DataFrame:
    """``base, go, nogo``: sessions of one base in both conditions."""
    side = lambda value, name: sessions.where(F.col(at) == value).select(base, F.col(session).alias(name))
    return side("GO", "go").join(side("NOGO", "nogo"), base)


def strongest(absorbers: DataFrame, base: str) -> DataFrame:
    """The state of greatest occupancy of each base, the least state on ties."""
    best = F.max_by(F.struct("state", "fo"), F.struct(F.col("fo"), F.col("state").alias("s")))
    return absorbers.groupBy(base).agg(best.alias("b")).select(base, F.col("b.state").alias("state"), F.col("b.fo").alias("fo"))


def compare_absorbers(a: DataFrame, b: DataFrame, base: str) -> DataFrame:
    """Both models' strongest absorbing state of each base that either has."""
    left, right = (strongest(x, base).select(base, F.col("state").alias(f"state_{k}"), F.col("fo").alias(f"fo_{k}")) for x, k in ((a, "a"), (b, "b")))
    both = left.join(right, base, "full_outer")
    return both.withColumns({"in_a": F.col("fo_a").isNotNull(), "in_b": F.col("fo_b").isNotNull(), "in_both": F.col("fo_a").isNotNull() & F.col("fo_b").isNotNull()})


def set_members(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Each key of either table with where it is: by union, intersection and differences."""
    left, right = a.select(key), b.select(key)
    tag = lambda df, name: df.withColumn("where", F.lit(name))
    parts = tag(left.intersect(right), "both"), tag(left.exceptAll(right).distinct(), "only_a"), tag(right.exceptAll(left).distinct(), "only_b"), tag(left.union(right).distinct(), "any")
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def experiment_id(paradigm: Column, model: Column, k: Column, pca: Column, lags: Column, reference: Column, downsample: Column | None = None) -> Column:
    """Name of an experiment from what it was run with; parts that are null are left out."""
    part = lambda letter, value: F.when(value.isNotNull(), F.concat(F.lit(letter), value.cast("string")))
    return F.concat_ws("_", paradigm, model, part("K", k), part("PCA", pca), part("L", lags), F.upper(reference), part("DS", F.lit(None) if downsample is None else downsample))
