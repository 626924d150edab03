"""Pattern counts, weighted scores and approximate phrases of free text."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(F.lower(text), F.lit(pattern)), F.lit(0)).cast("long")


def arg_max(scores: list[tuple[str, Column]], none: str = "unknown") -> Column:
    """The name of the largest positive score; of equals the first named."""
    best = F.array_max(F.array(*(F.struct(c.alias("s"), F.lit(-k).alias("p"), F.lit(n).alias("n")) for k, (n, c) in enumerate(scores))))
    return F.when(best["s"] > 0, best["n"]).otherwise(none)


def flags(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that hold, a bar between; "" if none does."""
    return F.concat_ws("|", *(F.when(c, F.lit(n)) for n, c in rules))


#: Patterns of stage phrases, in order, with the edits allowed and a
#: plain spelling of each.
PHRASES = (
    ("dpf|dfp", 0, "dpf"),
    ("hpf|hfp", 0, "hpf"),
    ("somites?", 2, "somite"),
    ("days? post[- ]?fertili[sz]ation", 2, "day post-fertilisation"),
    ("hours? post[- ]?fertili[sz]ation", 2, "hour post-fertilisation"),
    ("hour", 1, "hour"),
)
NUMBER = r"(?P<number>\d+\.?\d*)"


@lru_cache(maxsize=None)
def compiled(pattern: str, edits: int) -> regex.Pattern:
    return regex.compile(rf"(?b)(?:{pattern}){{e<={edits}}}" if edits else pattern)


#: Pieces of which any match of a pattern holds one unchanged: those of its fixed letters.
PIECES = {
    "somites?": ("so", "mi", "te"),
    "days? post[- ]?fertili[sz]ation": ("da", "post", "fert", "ation"),
    "hours? post[- ]?fertili[sz]ation": ("hour", "post", "fert", "ation"),
    "hour": ("ho", "ur"),
}


def approximate(pattern: str, edits: int, plain: str, text: str) -> str | None:
    """The match with fewest edits, of equals the first. With edits only the surroundings
    of unchanged pieces are searched."""
    if exact := compiled(pattern, 0).search(text):
        return exact.group()
    if not edits:
        return None
    reach, spans = 2 * len(plain) + 4, []
    for at in sorted(m.start() for x in PIECES[pattern] for m in regex.finditer(x, text)):
        if spans and at - reach <= spans[-1][1]:
            spans[-1][1] = at + reach
        else:
            spans.append([max(0, at - reach), at + reach])
    for e in range(1, edits + 1):
        for a, b in spans:
            if m := compiled(pattern, e).search(text, a, b):
                return m.group().strip()
    return None


def classify_stage(text: str | None) -> tuple[float | None, str | None]:
    """The number and the stage phrase, as written there, that belong together best.

    A phrase takes the first number that stands before it with no digit between, and the
    first behind it. Each such pair counts the length of the phrase less the distance
    between the starts of both; of equals the first found stays, in the order of
    ``PHRASES``."""
    best: tuple[int, float, str] | None = None
    if text and regex.search(r"\d", text):
        for pattern, edits, plain in PHRASES:
            phrase = approximate(pattern, edits, plain, text)
            if not phrase:
                continue
            said = f"(?P<phrase>{regex.escape(phrase)})"
            for both in (rf"{NUMBER}\D*?{said}", rf"{said}\D*?{NUMBER}"):
                m = regex.search(both, text)
                if m:
                    worth = len(phrase) - abs(m.start("number") - m.start("phrase"))
                    if best is None or worth > best[0]:
                        best = (worth, float(m["number"]), phrase)
    return best[1:] if best else (None, None)


def _stages(texts: pa.Array) -> pa.Array:
    # one text at a time is a string; the others stay in the Arrow batch
    found = [classify_stage(t.as_py()) for t in texts]
    return pa.StructArray.from_arrays([pa.array([v for v, _ in found], pa.float64()), pa.array([p for _, p in found], pa.string())], ["value", "phrase"])


def stage(text: Column) -> Column:
    """struct(value, phrase) of ``classify_stage``, by Arrow batches."""
    return F.arrow_udf(_stages, "value double, phrase string")(text)


def file_format(names: Column) -> Column:
    """A short label of the set of file kinds that a run's files are named by."""
    words = F.filter(F.split(names, r"\s+"), lambda w: w != "")
    kinds = F.array_join(F.array_sort(F.array_distinct(words)), "+")
    many = F.when(F.size(words) > 1, F.concat(F.lit(" ×"), F.size(words).cast("string"))).otherwise("")
    return (
        F.when(F.coalesce(F.size(words), F.lit(0)) <= 0, "unknown/NA")
        .when(kinds.isin("fastq", "bam", "cram"), F.concat(kinds, many))
        .when(names.contains("10X"), "10X bam")
        .when(kinds.isin("bam+cram", "bam+fastq", "nanopore"), kinds)
        .when(F.array_contains(words, "SOLiD_native"), "SOLiD")
        .when(names.contains("Illumina"), "Illumina native")
        .when(F.lower(names).contains("pacbio"), "pacbio")
        .otherwise(F.substring(names, 1, 25))
    )
