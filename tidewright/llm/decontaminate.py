"""Benchmark decontamination by template windows, in native column functions.

Tokens are runs of letters with their combining marks, single letters of scripts
that put no space between words, and numbers such as 3, 1,000 or 12:30; a mark
. ! ? : at the end stays with them for the next step. Canonicalisation replaces
- numbers with one placeholder,
- a unit right after a number with a second,
- a name (a capitalised word that does not start a sentence) with a third,
and puts all else in lower case. Windows of WINDOW canonical tokens are
hashed; document windows meet benchmark windows in a hash join. Documents
with a hit are read again with their slots: within a window each benchmark
value must stand for one document value, so that a question with other numbers
or names is caught while a chance likeness of templates is not, and one value
that differs costs only the windows that hold it twice. A pair is contaminated
if its consistent windows are at least MIN_COVERAGE of the item's.

Items up to WINDOW tokens are one window of their own length. What stands
before a document's window decides whether its first token is a name or a unit;
so a window whose first token is one is hashed a second time with that token in
lower case, for the items of one window: their exact copies are found after any
text. Longer items have other windows, and their first one counts only in its
context. Items below MIN_TOKENS tokens match the same tokens, in the same case,
without placeholders. Null and empty items match nothing, and null or empty texts match
nothing. Repeated rows count once: a pair gets one row with its
best coverage, also where one doc_id has several texts. Rows with a null key are
documents and items like others. Whole texts of any length are read. Extra
columns are not carried. An empty table on either side gives no pairs.

The benchmark's windows are broadcast if they are at most BROADCAST_ROWS, and
hash joined with a shuffle otherwise; so are the keys of documents with a hit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.storage import materialise

WINDOW = 8
MIN_TOKENS = 3
MIN_COVERAGE = 0.25
BROADCAST_ROWS = 1_000_000
# Scripts that put no space between words.
UNSPACED = "Han Hiragana Katakana Thai Lao Khmer Myanmar Tibetan".split()


def token_pattern(script: str) -> str:
    """Numbers, letters of unspaced scripts one by one, other words; `script` names a script in the engine's syntax."""
    apart = "".join(script.format(x) for x in UNSPACED)
    return rf"[0-9]+(?:[.,:/][0-9]+)*[.!?:]?|[{apart}]\p{{M}}*[.!?:]?|[^\P{{L}}{apart}](?:\p{{M}}|[^\P{{L}}{apart}])*[.!?:]?"


TOKEN = token_pattern(r"\p{{Is{}}}")
# Unit words and signs that follow a number.
UNITS = "mm cm m km in ft mi mg g kg t ml l s sec min h hr hrs ms kb mb gb tb hz khz mhz ghz w kw mw v kv a ma j kj cal kcal pa kpa usd eur gbp dollars euros cents percent meters metres kilometers kilometres miles feet inches grams kilograms pounds ounces liters litres seconds minutes hours days weeks months years degrees".split()
_NUMBER, _UNIT, _NAME = 1, 2, 3


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def _is_number(token: Column) -> Column:
    return F.ascii(token).between(48, 57)


def _plain(token: Column) -> Column:
    return F.lower(F.rtrim(token, F.lit(".!?:")))


def _kind(before: Column, token: Column) -> Column:
    """0, or the placeholder's number; `before` is the token before or empty."""
    head = F.substring(token, 1, 1)
    name = (head != F.lower(head)) & (before != "") & ~F.substring(before, -1, 1).isin(".", "!", "?", ":")
    return F.when(_is_number(token), _NUMBER).when(_is_number(before) & _plain(token).isin(UNITS), _UNIT).when(name, _NAME).otherwise(0)


def _with_before(raw: str, f: Callable[[Column, Column], Column]) -> Column:
    """f(token before, token) of each token. The lambda names no other column, so nothing is computed again inside."""
    r = F.col(raw)
    return F.slice(F.zip_with(F.concat(F.array(F.lit("")), r), r, f), F.lit(1), F.size(r))


def canonical(raw: str) -> Column:
    """The canonical tokens of the column `raw`; placeholders are <1>, <2> and <3>."""

    def one(before: Column, token: Column) -> Column:
        kind = _kind(before, token)
        return F.when(kind == 0, _plain(token)).otherwise(F.concat(F.lit("<"), kind, F.lit(">")))

    return _with_before(raw, one)


def values(raw: str) -> Column:
    """The value at each placeholder of the column `raw`, null elsewhere."""
    return _with_before(raw, lambda before, token: F.when(_kind(before, token) > 0, _plain(token)))


def plain_heads(raw: str) -> Column:
    """The plain form of each name and unit of the column `raw`, null elsewhere."""
    return _with_before(raw, lambda before, token: F.when(_kind(before, token) > _NUMBER, _plain(token)))


def exact(raw: str) -> Column:
    """The tokens of the column `raw` as they are but for the mark at the end, apart from canonical ones."""
    return F.transform(raw, lambda token: F.concat(F.lit("="), F.rtrim(token, F.lit(".!?:"))))


def with_windows(df: DataFrame, width: int, name: str = "hashes") -> DataFrame:
    """Add the hashes of all windows of `width` tokens of the column `canon`; none if there are fewer.

    Doubles the width where it can; each step is a column of its own, so that it is computed once. With a column
    `heads`, `<name>_plain` has the hashes of the windows with a plain first token, null where the first is no name or unit.
    """
    df = df.withColumn("_1", F.transform("canon", lambda t: F.xxhash64(t)))
    done, size = 1, F.size("canon")
    plain = "heads" in df.columns
    if plain:
        df = df.withColumn("_p1", F.transform("heads", lambda t: F.when(t.isNotNull(), F.xxhash64(t))))
    while done < width:
        other, step = (f"_{done}", done) if done * 2 <= width else ("_1", 1)
        df = df.withColumn(f"_{done + step}", F.zip_with(f"_{done}", F.slice(F.col(other), F.lit(done + 1), F.greatest(size, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
        if plain:
            df = df.withColumn(f"_p{done + step}", F.zip_with(f"_p{done}", F.slice(F.col(other), F.lit(done + 1), F.greatest(size, F.lit(0))), lambda a, b: F.when(a.isNotNull(), F.xxhash64(a, b))))
        done += step
    whole = [(name, f"_{width}"), *([(f"{name}_plain", f"_p{width}")] if plain else [])]
    return df.withColumns({n: F.slice(F.col(c), F.lit(1), F.greatest(size - (width - 1), F.lit(0))) for n, c in whole})


def _hashes(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Keys and hash of every window."""
    # an inner explode would make Spark test the arrays' sizes on a second computation of them
    df = with_windows(df, width)
    hashes = F.concat("hashes", "hashes_plain") if "heads" in df.columns else F.col("hashes")
    return df.select(*keys, F.explode_outer(hashes).alias("hash")).where(F.col("hash").isNotNull())


def _windows(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Keys, width, pos, hash, slots (values at the placeholders, in order) and plain (first token taken so) of every window; df has canon and vals."""
    staged = with_windows(df.where(F.size("canon") >= width), width)
    starts = F.sequence(F.lit(1), F.greatest(F.size("canon") - (width - 1), F.lit(1)))
    slots = F.transform(starts, lambda s: F.filter(F.slice(F.col("vals"), s, F.lit(width)), lambda v: v.isNotNull()))
    plain = [F.col("hashes_plain").alias("other")] if "heads" in df.columns else []
    staged = staged.select(*keys, F.posexplode_outer(F.arrays_zip(F.col("hashes").alias("hash"), slots.alias("slots"), *plain)).alias("pos", "_w"))
    form = F.struct(F.col("_w")["hash"].alias("hash"), F.col("_w")["slots"].alias("slots"), F.lit(False).alias("plain"))
    if plain:  # a plain first token is no slot
        rest = F.slice(F.col("_w")["slots"], F.lit(2), F.greatest(F.size(F.col("_w")["slots"]), F.lit(0)))
        form = F.explode(F.array(form, F.struct(F.col("_w")["other"].alias("hash"), rest.alias("slots"), F.lit(True).alias("plain"))))
    staged = staged.where(F.col("pos").isNotNull()).select(*keys, F.lit(width).alias("width"), "pos", form.alias("_f"))
    return staged.select(*keys, "width", "pos", *[F.col("_f")[c].alias(c) for c in ("hash", "slots", "plain")]).where(F.col("hash").isNotNull())


def _forms(df: DataFrame, keys: list[str], width: int, heads: bool = False) -> DataFrame:
    """Keys and the columns canon, vals and, if asked for, heads of the column `raw` for windows of `width`."""
    if width < MIN_TOKENS:
        none = F.transform("raw", lambda t: F.lit(None).cast("string"))
        return df.select(*keys, exact("raw").alias("canon"), none.alias("vals"))
    return df.select(*keys, canonical("raw").alias("canon"), values("raw").alias("vals"), *([plain_heads("raw").alias("heads")] if heads else []))


def benchmark_windows(benchmark: DataFrame, width: int = WINDOW) -> tuple[DataFrame, dict[int, bool]]:
    """item_id, item_windows, width, pos, hash, slots of the benchmark; and the widths in use, and if an item has one window of it."""
    items = benchmark.select("item_id", tokens(F.col("text")).alias("raw")).where(F.size("raw") > 0)
    kinds = materialise(items.withColumn("_n", F.size("raw")).withColumn("_w", F.least(F.col("_n"), F.lit(width))), "bench-items")
    widths = dict(map(tuple, kinds.groupBy("_w").agg(F.bool_or(F.col("_n") == F.col("_w"))).collect()))  # at most `width` values
    out = None
    for w in sorted(widths) or [width]:
        part = kinds.where(F.col("_w") == w).withColumn("item_windows", F.col("_n") - (w - 1))
        part = _windows(_forms(part, ["item_id", "item_windows"], w), ["item_id", "item_windows"], w)
        out = part if out is None else out.unionByName(part)
    return out.drop("plain"), widths


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, broadcast if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Contaminated pairs: doc_id, item_id, matched, item_windows, coverage, changed_slots."""
    windows, widths = benchmark_windows(benchmark, width)
    windows = materialise(windows, "bench-windows")
    n_windows = windows.count()
    rows = docs.select("doc_id", "text").withColumn("row", F.xxhash64("text"))
    tokenised = rows.select("doc_id", "row", tokens(F.col("text")).alias("raw"))
    hits = None
    for w, short in sorted(widths.items()):
        known = _small(windows.where(F.col("width") == w).select("hash").distinct(), n_windows)
        part = _hashes(_forms(tokenised, ["doc_id", "row"], w, short).drop("vals"), ["doc_id", "row"], w).join(known, "hash", "left_semi").select("doc_id", "row")
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = rows.select("doc_id", "row").limit(0)
    hits = materialise(hits.distinct(), "bench-hits")
    found = rows.join(_small(hits, hits.count()), ["doc_id", "row"], "left_semi").dropDuplicates(["doc_id", "row"])
    held = materialise(found.select("doc_id", "row", tokens(F.col("text")).alias("raw")), "bench-docs")
    pairs = None
    for w, short in sorted(widths.items()) or [(width, False)]:
        b = windows.where(F.col("width") == w).select("item_id", "item_windows", F.col("pos").alias("item_pos"), "hash", F.col("slots").alias("item_slots"))
        d = _windows(_forms(held, ["doc_id", "row"], w, short), ["doc_id", "row"], w).select("doc_id", "row", "pos", "hash", "slots", "plain")
        part = d.join(_small(b, n_windows), "hash").where(~F.col("plain") | (F.col("item_windows") == 1))
        pairs = part if pairs is None else pairs.unionByName(part)
    filled = F.zip_with("item_slots", "slots", lambda b, d: F.struct(b.alias("b"), d.alias("d")))
    slots = F.array_distinct(filled)
    consistent = pairs.withColumn("filled", slots).where(F.size(F.array_distinct(F.transform("filled", lambda x: x["b"]))) == F.size("filled"))
    # a document may repeat a passage: alignments are merged window by window
    changed = F.exists("filled", lambda x: x["b"] != x["d"])
    merged = consistent.groupBy("doc_id", "row", "item_id", "item_windows").agg(F.countDistinct("item_pos").alias("matched"), F.max(changed).alias("changed"))
    flagged = merged.where(F.col("matched") >= F.lit(min_coverage) * F.col("item_windows"))
    return flagged.groupBy("doc_id", "item_id", "item_windows").agg(F.max("matched").cast("long").alias("matched"), F.max("changed").alias("changed_slots")).select("doc_id", "item_id", "matched", F.col("item_windows").cast("long").alias("item_windows"), F.round(F.col("matched") / F.col("item_windows"), 6).alias("coverage"), "changed_slots")


_UNIT_LIST = ", ".join(f"'{u}'" for u in UNITS)

_TOKEN_SQL = token_pattern(r"\p{{{}}}")

#: The same for DuckDB, over documents and benchmark. Windows are compared as texts, not as hashes.
ORACLE_SQL = rf"""
WITH toks AS (
  SELECT 'd' AS side, doc_id AS id, md5(text) AS row, regexp_extract_all(coalesce(text, ''), '{_TOKEN_SQL}') AS raw FROM documents
  UNION ALL
  SELECT 'b', item_id, '', regexp_extract_all(coalesce(text, ''), '{_TOKEN_SQL}') FROM benchmark
), uniq AS (SELECT DISTINCT side, id, row, raw FROM toks),
flat AS (
  SELECT side, id, row, len(raw) AS n, u.i AS i, raw[u.i] AS tok, CASE WHEN u.i > 1 THEN raw[u.i - 1] END AS prev
  FROM uniq, (SELECT unnest(range(1, len(raw) + 1)) AS i) AS u
), kinds AS (
  SELECT *, lower(rtrim(tok, '.!?:')) AS plain,
    CASE WHEN regexp_matches(tok, '^[0-9]') THEN '<1>'
      WHEN prev IS NOT NULL AND regexp_matches(prev, '^[0-9]') AND lower(rtrim(tok, '.!?:')) IN ({_UNIT_LIST}) THEN '<2>'
      WHEN substr(tok, 1, 1) <> lower(substr(tok, 1, 1)) AND prev IS NOT NULL AND NOT regexp_matches(prev, '[.!?:]$') THEN '<3>' END AS kind
  FROM flat
), lists AS (
  SELECT side, id, row, n, list(coalesce(kind, plain) ORDER BY i) AS canon, list(CASE WHEN kind IS NOT NULL THEN plain END ORDER BY i) AS vals,
    list(CASE WHEN kind IN ('<2>', '<3>') THEN plain END ORDER BY i) AS heads, list('=' || rtrim(tok, '.!?:') ORDER BY i) AS exact
  FROM kinds GROUP BY ALL
), bw AS (
  SELECT id AS item_id, least(n, {WINDOW}) AS w, n - least(n, {WINDOW}) + 1 AS item_windows, p.i AS item_pos,
    CASE WHEN n < {MIN_TOKENS} THEN exact ELSE canon[p.i : p.i + least(n, {WINDOW}) - 1] END AS win,
    CASE WHEN n < {MIN_TOKENS} THEN [] ELSE list_filter(vals[p.i : p.i + least(n, {WINDOW}) - 1], lambda x: x IS NOT NULL) END AS item_slots
  FROM lists, (SELECT unnest(range(1, n - least(n, {WINDOW}) + 2)) AS i) AS p WHERE side = 'b'
), dw AS (
  SELECT id AS doc_id, row, k.w AS w, CASE WHEN k.w < {MIN_TOKENS} THEN exact[p.i : p.i + k.w - 1] ELSE canon[p.i : p.i + k.w - 1] END AS win,
    CASE WHEN k.w < {MIN_TOKENS} THEN [] ELSE list_filter(vals[p.i : p.i + k.w - 1], lambda x: x IS NOT NULL) END AS slots, heads[p.i] AS head
  FROM lists, (SELECT DISTINCT w FROM bw) AS k, (SELECT unnest(range(1, n - k.w + 2)) AS i) AS p WHERE side = 'd' AND n >= k.w
), forms AS (
  SELECT doc_id, row, w, win, slots, FALSE AS plain FROM dw
  UNION ALL
  SELECT doc_id, row, w, list_concat([head], win[2:]), slots[2:], TRUE FROM dw WHERE w >= {MIN_TOKENS} AND head IS NOT NULL
), pairs AS (
  SELECT doc_id, row, item_id, item_windows, item_pos, list_distinct(list_transform(range(1, len(slots) + 1), lambda k: [item_slots[k], slots[k]])) AS filled
  FROM forms JOIN bw USING (w, win) WHERE NOT plain OR item_windows = 1
), good AS (
  SELECT *, len(list_filter(filled, lambda x: x[1] <> x[2])) > 0 AS changed FROM pairs WHERE len(list_distinct(list_transform(filled, lambda x: x[1]))) = len(filled)
), merged AS (
  SELECT doc_id, row, item_id, item_windows, count(DISTINCT item_pos) AS matched, bool_or(changed) AS changed FROM good GROUP BY ALL
)
SELECT doc_id, item_id, max(matched)::BIGINT AS matched, item_windows::BIGINT AS item_windows,
  round(max(matched) / item_windows, 6) AS coverage, bool_or(changed) AS changed_slots
FROM merged WHERE matched >= {MIN_COVERAGE} * item_windows GROUP BY doc_id, item_id, item_windows
"""
