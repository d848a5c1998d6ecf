"""Quality rules: a table of thresholds compiled into one projection, with DataFrame functions alone.

A measure is an integer of one text; a rule bounds the ratio of two measures by a fraction on either side. Compiled, a rule compares products
of integers, so no verdict hangs on rounding. The base rules come first: a document that fails one is dropped whatever the others say.

Measures: words `[^\\x20\\x09-\\x0D]+`, the code points in them, symbols, lines with a word, those equal to an earlier line, words in a 3-word
window that the text holds twice or more, stop words. Windows are compared by hash first; a text in which two hashes agree has its windows sorted
and compared whole, so no chance collision counts.

Cases: a null or empty text has no words, fails `too few words` and is dropped; rows are judged by their own text alone, so repeated rows and null
ids don't matter; further columns stay, but those with a measure's name are replaced (give a `prefix` to keep them; filter_quality does).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# Frequent words of the corpus's four languages, without which running prose is rare.
STOP_WORDS = (
    "the of and to a in is that it for was on with as this by be are from at "
    "de la que el en y los se las del un por con no una su para al es "
    "le et les des du une pour est dans qui par sur pas au avec "
    "der die und den von zu das mit sich auf für ist dem im nicht ein eine als"
).split()


@dataclass(frozen=True)
class Rule:
    """of / per must be at least low and at most high, each a fraction (above, below). per None: `of` alone. 0 / 0 passes."""

    name: str
    of: str
    per: str | None = None
    low: tuple[int, int] | None = None
    high: tuple[int, int] | None = None

    def broken(self, value) -> Column:
        """Whether the rule is broken; `value` gives a measure's column by name."""
        of, per = value(self.of), value(self.per) if self.per else F.lit(1).cast("long")
        out = F.lit(False)
        if self.low:
            out = out | (of * self.low[1] < per * self.low[0])
        if self.high:
            out = out | (of * self.high[1] > per * self.high[0])
        return out


BASE = (
    Rule("too few words", "n_words", low=(50, 1)),
    Rule("repeated phrases", "n_repeat_words", "n_words", high=(50, 100)),
)
RULES = (
    Rule("too many words", "n_words", high=(1_000_000, 1)),
    Rule("word length", "word_chars", "n_words", low=(25, 10), high=(12, 1)),
    Rule("symbols", "n_symbols", "n_words", high=(1, 10)),
    Rule("stop words", "n_stop_words", "n_words", low=(2, 100)),
    Rule("repeated lines", "n_dup_lines", "n_lines", high=(40, 100)),
)
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _fixed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with further columns that later filters and lambdas read as they are: the optimiser never copies a generator's expression into them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _covered(placed: Column, same) -> Column:
    """Words inside windows that equal a neighbour. placed: sorted structs with the window's place `i`; `same` compares two of them."""

    def count(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(same(F.get(s, k - 1), x), F.lit(False)) | F.coalesce(same(F.get(s, k + 1), x), F.lit(False)))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return _let(placed, count)


def _let(value: Column, use) -> Column:
    """use(value), with the value computed once: an array of one is transformed."""
    return F.get(F.transform(F.array(value), use), 0)


def _repeat_words(words: Column, hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more. hashes: of the windows. Windows of one hash are neighbours once sorted; where two such
    are found to differ, windows are sorted by their words instead."""
    word = lambda x, j: F.get(words, x["i"] + j)
    by_hash = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    by_words = F.sort_array(F.transform(hashes, lambda h, i: F.struct(F.get(words, i).alias("a"), F.get(words, i + 1).alias("b"), F.get(words, i + 2).alias("c"), i.alias("i"))))
    differ = lambda x, y: (x["h"] == y["h"]) & ((word(x, 0) != word(y, 0)) | (word(x, 1) != word(y, 1)) | (word(x, 2) != word(y, 2)))

    def count(s: Column) -> Column:
        clash = F.size(F.filter(s, lambda x, k: F.coalesce(differ(F.get(s, k - 1), x), F.lit(False)))) > 0
        same_words = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
        return F.when(clash, _covered(by_words, same_words)).otherwise(_covered(s, lambda x, y: x["h"] == y["h"]))

    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), _let(by_hash, count)).otherwise(0)


def measure(docs: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with a column for each measure (long), its name after `prefix`; columns that have such a name already are replaced."""
    tag = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))
    t, words, lines, single, hashes = (tag + x for x in ("text", "words", "lines", "single", "hashes"))
    parts = _fixed(docs, {t: F.coalesce(text, F.lit(""))})
    parts = _fixed(parts, {words: F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lines: F.filter(F.split(t, "\n", -1), lambda x: _without(x, BLANK) > 0)})
    w = F.col(words)
    parts = _fixed(parts, {single: F.transform(w, lambda x: F.xxhash64(x))})
    starts = F.slice(single, 1, F.greatest(F.size(w) - 2, F.lit(0)))
    parts = _fixed(parts, {hashes: F.transform(starts, lambda h, i: F.xxhash64(h, F.get(single, i + 1), F.get(single, i + 2)))})
    values = {
        "n_words": F.size(w),
        "word_chars": _without(F.col(t), BLANK),
        "n_symbols": F.length(t) - _without(F.col(t), SYMBOLS),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(w, F.col(hashes)),
        "n_lines": F.size(lines),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS, *[s.capitalize() for s in STOP_WORDS]))),
    }
    stay = [F.col(f"`{c}`") for c in docs.columns if c not in {prefix + m for m in MEASURES}]
    return parts.select(*stay, F.inline(F.array(F.struct(*[values[m].cast("long").alias(prefix + m) for m in MEASURES]))))


def judge(measured: DataFrame, base: tuple[Rule, ...] = BASE, rules: tuple[Rule, ...] = RULES, prefix: str = "") -> DataFrame:
    """measured with base_failed, kept, and failed_rules: the names of the broken rules in the table's order, comma-joined."""
    value = lambda m: F.col(f"`{prefix}{m}`")
    broken = [F.when(r.broken(value), F.lit(r.name)) for r in (*base, *rules)]
    some = lambda table: F.coalesce(*[F.when(r.broken(value), F.lit(True)) for r in table], F.lit(False))
    return measured.withColumns(
        {prefix + "base_failed": some(base), prefix + "kept": ~some((*base, *rules)), prefix + "failed_rules": F.array_join(F.array_compact(F.array(*broken)), ",")}
    )


def filter_quality(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that break no rule, with their own columns."""
    prefix = "_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return judge(measure(docs, text, prefix), prefix=prefix).where(F.col(prefix + "kept")).select(*[F.col(f"`{c}`") for c in docs.columns])


def op12_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(measure(docs)).drop("text")


def _sql_broken(r: Rule) -> str:
    per, out = r.per or "1", []
    if r.low:
        out.append(f"{r.of} * {r.low[1]} < {per} * {r.low[0]}")
    if r.high:
        out.append(f"{r.of} * {r.high[1]} > {per} * {r.high[0]}")
    return f"({' OR '.join(out)})"


_STOP = ", ".join(f"'{s}'" for s in (*STOP_WORDS, *[s.capitalize() for s in STOP_WORDS]))
OP12_SQL = f"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents),
windows AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, CAST(len(w) AS BIGINT) - 1)) AS i FROM t)),
twice AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    coalesce(covered.n, 0) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(list_filter(w, lambda x: x IN ({_STOP}))) AS BIGINT) AS n_stop_words
  FROM t LEFT JOIN covered USING (rid))
SELECT *, ({" OR ".join(map(_sql_broken, BASE))}) AS base_failed, NOT ({" OR ".join(map(_sql_broken, (*BASE, *RULES)))}) AS kept,
  concat_ws(',', {", ".join(f"CASE WHEN {_sql_broken(r)} THEN '{r.name}' END" for r in (*BASE, *RULES))}) AS failed_rules
FROM m
"""
