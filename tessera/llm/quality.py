"""Quality rules with thresholds that adapt to each language and source.

Each rate of a text (mean word length, symbols, repeated lines, repeated words) is an integer. The sketch of a
group is the number of texts at each value rounded down to seven significant bits. Such counts merge by
addition, so sketches of (language, source) give those of a language and of the whole corpus, and a quantile
read from one is within 1/64 of the true one. The counts of a group don't depend on how rows are spread, so
the verdicts don't either.

A rule's upper bound is the group's median and the greatest of `REACH_LOW` times its lower spread (median less lower
quartile), `REACH_HIGH` times its upper spread (upper quartile less median) and a tolerance; the lower bound of word
length is the median less the greater of lower spread and tolerance. Up to a quarter of bad texts in a group move
neither quartile. The upper spread lets a source have rates that most of its texts haven't, such as symbols.

Groups with fewer texts than `min_group` take the bounds of their language, and languages with fewer than a tenth of
that those of the corpus, since quartiles of few texts say little.

Null text: no words, base_failed. Null language or source: the group of the empty name. Texts of any length are
measured whole. Repeated rows each count, and get one verdict, as do ties. Columns besides text, lang and source are
handed on; names that begin with two underscores are taken. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, materialise, text_of

SYMBOLS = "#*$%&|<>"
FEATURES = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
MARK = "__quality"


@dataclass(frozen=True)
class Rule:
    """`of` is counted in thousandths of `per`; `slack` is the least distance of a bound from the median."""

    name: str
    of: str
    per: str
    slack: int
    below: bool = False

    @property
    def low(self) -> str:
        return f"q50 - greatest({self.slack}, {REACH_LOW} * (q50 - q25))" if self.below else "cast(-1 as bigint)"

    @property
    def high(self) -> str:
        return f"q50 + greatest({self.slack}, {REACH_LOW} * (q50 - q25), {REACH_HIGH} * (q75 - q50))"


RULES = (
    Rule("word_length", "word_chars", "n_words", 500, below=True),
    Rule("symbols", "n_symbols", "n_words", 100),
    Rule("dup_lines", "n_dup_lines", "n_lines", 350),
    Rule("repeats", "n_repeat_words", "n_words", 300),
)
REACH_LOW, REACH_HIGH = 8, 4
MIN_GROUP = 200
MIN_WORDS = 50
QUARTILES = ("q25", "q50", "q75")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    base = len(ids)
    pairs = seq[:-1] * base + seq[1:]
    if base >= 1 << 20:  # so that the keys of three words stay below 2^63
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, at, counts = np.unique(pairs[:-1] * base + seq[2:], return_inverse=True, return_counts=True)
    again = counts[at] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of a whole text."""
    text = text_of(text)
    words = text.encode("utf-8", "replace").split()
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def measured_column(texts: pd.Series) -> pd.DataFrame:
    names = [x.split()[0] for x in FEATURES.split(", ")]
    return pd.DataFrame([measure(x) for x in texts], columns=names, dtype="int64")


def _measured(column: str) -> Column:
    return F.pandas_udf(measured_column, FEATURES)(column)


def _rate(rule: Rule) -> Column:
    return F.expr(f"{MARK}.{rule.of} * 1000 div greatest({MARK}.{rule.per}, 1)")


def _base_failed() -> Column:
    return F.expr(f"{MARK}.n_words < {MIN_WORDS} or 100 * {MARK}.n_repeat_words > 50 * {MARK}.n_words")


def sketches(measured: DataFrame) -> DataFrame:
    """lang, source, rule, value (seven significant bits) and n, over the texts that pass the base rules."""
    rates = F.array(*(F.struct(F.lit(k).alias("rule"), _rate(r).alias("rate")) for k, r in enumerate(RULES)))
    short = "greatest(length(bin(rate)) - 7, 0)"
    return (
        measured.where(~_base_failed())
        .select(_group("lang"), _group("source"), F.explode(rates).alias("x"))
        .select("__lang", "__source", "x.rule", "x.rate")
        .groupBy("__lang", "__source", "rule", F.expr(f"shiftleft(shiftright(rate, {short}), {short})").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _group(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(f"__{name}")


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The three quartiles of each merged sketch, and the number of texts in it."""
    merged = sketch.groupBy(*keys, "rule", "value").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "rule")
    upto = merged.withColumns({"upto": F.sum("n").over(group.orderBy("value")), "total": F.sum("n").over(group)})
    least = lambda share: F.min(F.when(F.col("upto") * 4 >= F.col("total") * share, F.col("value")))
    return upto.groupBy(*keys, "rule").agg(F.max("total").alias("total"), *(least(k).alias(q) for k, q in enumerate(QUARTILES, 1)))


def thresholds(sketch: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """A row for each (lang, source) with lo_ and hi_ of every rule. Its size is that of the groups, not of the texts."""
    fine = _quantiles(sketch, ["__lang", "__source"])
    mid = _quantiles(sketch, ["__lang"]).withColumnsRenamed({c: f"m_{c}" for c in ("total", *QUARTILES)})
    top = _quantiles(sketch, []).drop("total").withColumnsRenamed({c: f"t_{c}" for c in QUARTILES})
    met = fine.join(mid, ["__lang", "rule"]).join(top, "rule")
    pick = lambda c: F.when(F.col("total") >= min_group, F.col(c)).when(F.col("m_total") >= min_group // 10, F.col(f"m_{c}")).otherwise(F.col(f"t_{c}"))
    chosen = met.withColumns({c: pick(c) for c in QUARTILES})
    bounds = []
    for k, r in enumerate(RULES):
        one = lambda c, k=k: F.max(F.when(F.col("rule") == k, c))
        bounds += [one(F.expr(r.low)).alias(f"lo_{k}"), one(F.expr(r.high)).alias(f"hi_{k}")]
    return chosen.groupBy("__lang", "__source").agg(*bounds)


def judge(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """docs (text, lang, source and anything else) with the struct `__quality`, base_failed and kept in it.

    The texts are measured once and written to the scratch folder with the columns given; drop text beforehand
    where it isn't wanted afterwards.
    """
    measured = materialise(docs.withColumn(MARK, _measured("text")), "measured")
    return verdicts(measured, min_group)


def verdicts(measured: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    limits = materialise(thresholds(materialise(sketches(measured), "sketches"), min_group), "limits")
    inside = F.lit(True)
    for k, r in enumerate(RULES):
        inside = inside & _rate(r).between(F.col(f"lo_{k}"), F.col(f"hi_{k}"))
    base = _base_failed()
    mine = [F.col(c) for c in measured.columns if c != MARK]
    keyed = measured.withColumns({"__lang": _group("lang"), "__source": _group("source")})
    joined = keyed.join(limits, ["__lang", "__source"], "left")
    mark = F.struct(f"{MARK}.*", base.alias("base_failed"), (~base & F.coalesce(inside, F.lit(False))).alias("kept"))
    return joined.select(*mine, mark.alias(MARK))


def quality_rules(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """doc_id, the base figures, base_failed and kept of every document."""
    lean = docs.select("doc_id", "text", "lang", "source").withColumn(MARK, _measured("text")).drop("text")
    judged = verdicts(materialise(lean, "measured"), min_group)
    return judged.select(F.col("doc_id").cast("long").alias("doc_id"), f"{MARK}.*")


def quality_filter(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """The documents that are kept, with their own columns."""
    return judge(docs, min_group).where(f"{MARK}.kept").drop(MARK)


def oracle_sql() -> str:
    """quality_rules() over `documents` in DuckDB SQL."""
    word, short = r"[^\x20\x09-\x0D]+", "greatest(length(bin(rate)) - 7, 0)"
    levels = []
    for name, keys in (("fine", "lang, source, "), ("mid", "lang, "), ("top", "")):
        levels.append(f"""{name}_n as (select {keys}rule, value, sum(n) as n from sketch group by {keys}rule, value),
{name}_c as (select {keys}rule, value, sum(n) over (partition by {keys}rule order by value) as upto, sum(n) over (partition by {keys}rule) as total from {name}_n),
{name} as (select {keys}rule, max(total) as total, min(case when upto * 4 >= total then value end) as q25, min(case when upto * 4 >= total * 2 then value end) as q50, min(case when upto * 4 >= total * 3 then value end) as q75 from {name}_c group by {keys}rule)""")
    rates = " union all ".join(f"select rid, lang, source, {k} as rule, {r.of} * 1000 // greatest({r.per}, 1) as rate from marked" for k, r in enumerate(RULES))
    pick = lambda c: f"case when fine.total >= {MIN_GROUP} then fine.{c} when mid.total >= {MIN_GROUP // 10} then mid.{c} else top.{c} end as {c}"
    own = ", ".join(map(pick, QUARTILES))
    within = " or ".join(f"(r.rule = {k} and r.rate between {r.low} and {r.high})" for k, r in enumerate(RULES))
    return f"""
with docs as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, coalesce(lang, '') as lang, coalesce(source, '') as source from documents),
words as (select rid, regexp_extract_all(text, '{word}') as w from docs),
pos as (select rid, unnest(w) as word, generate_subscripts(w, 1) as i from words),
windows as (select rid, i, word, lead(word, 1) over o as word2, lead(word, 2) over o as word3 from pos window o as (partition by rid order by i)),
found as (select rid, i, count(*) over (partition by rid, word, word2, word3) as n from windows where word3 is not null),
covered as (select rid, count(distinct i + k) as n_repeat_words from found, (values (0), (1), (2)) as s(k) where n > 1 group by rid),
lines as (select rid, unnest(string_split(text, chr(10))) as line from docs),
line_counts as (select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines from lines where regexp_matches(line, '{word}') group by rid),
base as (select d.rid, d.doc_id, d.lang, d.source, len(w)::bigint as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, coalesce(n_lines, 0)::bigint as n_lines,
    coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from docs d join words using (rid) left join covered using (rid) left join line_counts using (rid)),
marked as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from base),
rates as ({rates}),
sketch as (select r.lang, r.source, rule, (rate >> {short}) << {short} as value, count(*) as n from rates r join marked m using (rid) where not base_failed group by r.lang, r.source, rule, value),
{", ".join(levels)},
limits as (select fine.lang, fine.source, fine.rule, {own} from fine join mid using (lang, rule) join top using (rule)),
verdict as (select rid, bool_and({within}) as inside from rates r join limits l on r.lang = l.lang and r.source = l.source and r.rule = l.rule group by rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(inside, false) as kept
from marked left join verdict using (rid)"""
