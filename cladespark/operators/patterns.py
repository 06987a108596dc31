"""Very many patterns against very many names: each pattern is tested only where a piece of text that it requires is found.

A pattern's required text are the plain characters that every match holds side by side, its anchors included. Of that, the piece
that the fewest names have is the pattern's key; pieces are as long as the text allows, in a few lengths, so more patterns with
longer texts have no more of them on one key. Names are cut into all their pieces of the lengths in use and looked up, so
a name meets the few patterns whose key it holds. Patterns without plain characters are tested on all names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cladespark.functions.tables import BROADCAST_ROWS, broadcast_if_small, fits, stored, with_panel

GRAMS = (3, 4, 6, 8, 12, 16)
FEW_PATTERNS = 200
START, END = "\x02", "\x03"
GAP = "\x00"

# Syntax under which plain characters may not be required, and, in this order, what ends or takes from a run of them.
UNCLEAR = r"\(\?[^:]|[\x00\x02\x03]|(^|[^\\])(\\\\)*\\$|\\[^dDwWsSbB\p{Punct}]|\\Q|&&"
GAPS = (
    (r"\\.", GAP),  # an escape: a class, a border or a plain character, which is not used
    (r"\[\^?\]?[^\[\]]*\]", GAP),  # a class
    *[(r"\((\?:)?[^()]*\)([*?+]|\{[^}]*\})?[+?]?", GAP)] * 3,  # groups, three deep, whatever they hold
    (r"^\^", START),
    (r"\$$", END),
    (r"\+[+?]?", GAP),  # the character before is required, but others may follow it
    (r"[^\x00]?\{[^}]*\}[+?]?", GAP),  # the character before may be missing
    (r"[^\x00]?[*?][+?]?", GAP),
    (r"[.^$]", GAP),
)


def required_text(pattern: Column) -> Column:
    """The longest text that every match of a pattern holds, with marks for the start and the end of a name; NULL if none is known.

    Only plain syntax is looked into: groups are passed over, alternatives outside of them and anything unusual give NULL.
    """
    rest = pattern
    for syntax, gap in GAPS:
        rest = F.regexp_replace(rest, F.lit(syntax), F.lit(gap))
    runs = F.split(rest, GAP)
    by_length = F.array_max(F.transform(runs, lambda run: F.struct(F.length(run).alias("length"), run.alias("run"))))
    unclear = pattern.rlike(UNCLEAR) | rest.rlike(r"[\[\]{}*+?\\()|]")
    return F.when(~unclear & (by_length["length"] > 0), by_length["run"])


def _grams(text: Column) -> Column:
    """All pieces of a text of the longest of ``GRAMS`` that it has; a shorter text is one itself."""
    size = F.length(text)
    for length in GRAMS:
        size = F.when(F.length(text) >= length, F.lit(length)).otherwise(size)
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def _name_grams(names: DataFrame, column: str, lengths: list[int]) -> DataFrame:
    """Names with every text of the lengths in them (``gram``), once for each place it is at. A name is marked at both ends; a line break at its end may be left out."""
    name, broken = F.col(column), r"(\r\n|[\n\r\x{85}\x{2028}\x{2029}])\z"
    marked = [F.concat(F.lit(START), n, F.lit(END)) for n in (name, F.regexp_replace(name, broken, ""))]
    texts = names.select(column, F.explode(F.when(name.rlike(broken), F.array(*marked)).otherwise(F.array(marked[0]))).alias("_text"))
    size = F.length("_text")
    starts = texts.select("*", F.explode(F.sequence(F.lit(1), F.greatest(size - (min(lengths) - 1), F.lit(1)))).alias("_at"))
    pieces = [F.when(F.col("_at") <= F.greatest(size - (n - 1), F.lit(1)), F.substring("_text", F.col("_at"), F.lit(n))) for n in lengths]
    return starts.select(column, F.explode(F.array(*pieces)).alias("gram")).where(F.col("gram").isNotNull())


def matching_names(names: DataFrame, patterns: DataFrame, column: str) -> DataFrame:
    """Names (``column``) that hold a match of any of ``patterns`` (pattern); a name may be there more than once.

    NULL names and patterns match nothing. Up to ``FEW_PATTERNS`` are tested on all names. Of more, the keys of the patterns come from two counts of the names, so a pattern's key is in few of them if any
    part of it is; a pattern whose every part is in very many names is tested on those.
    """
    listed = patterns.select("pattern").where(F.col("pattern").isNotNull()).distinct()
    few = fits(listed, FEW_PATTERNS)
    listed = listed.withColumn("required", F.lit(None).cast("string") if few else required_text(F.col("pattern")))
    cut = names.select(column).where(F.col(column).isNotNull())
    if few:
        return _tested(cut, listed, column)
    # Both are read several times.
    cut = stored(cut, "names")
    listed = stored(listed.select("pattern", "required", _grams(F.col("required")).alias("grams")), "patterns")
    keyed = listed.where("required IS NOT NULL").select("pattern", F.explode("grams").alias("gram"))
    found = _tested(cut, listed, column)
    for lengths in _lengths(keyed):
        grams = _name_grams(cut, column, lengths)
        of_length = keyed.where(F.length("gram").isin(lengths))
        wanted = broadcast_if_small(of_length.select("gram").distinct())
        counts = grams.join(wanted, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
        # A gram that no name has comes first: its pattern matches nothing.
        rarest = F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")
        keys = of_length.join(broadcast_if_small(counts), "gram", "left").groupBy("pattern").agg(rarest)
        met = grams.join(broadcast_if_small(keys), "gram").where(F.regexp_like(column, "pattern"))
        found = found.unionByName(met.select(column))
    return found


def _tested(names: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """Names that match a pattern without a required text, each tested on all."""
    return with_panel(names, listed.where("required IS NULL").select("pattern")).where(F.regexp_like(column, "pattern")).select(column)


def _lengths(keyed: DataFrame) -> list[list[int]]:
    """The lengths of grams in use: those whose grams can be broadcast together, and all others, which have to be moved."""
    sizes = keyed.groupBy(F.length("gram").alias("length")).agg(F.count("*").alias("n")).orderBy("n", "length").collect()
    total, light, heavy = 0, [], []
    for length, n in sizes:
        total += n
        (light if total <= BROADCAST_ROWS else heavy).append(length)
    return [sorted(lengths) for lengths in (light, heavy) if lengths]
