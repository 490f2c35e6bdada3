"""Fill-in-the-middle: texts cut into prefix, middle and suffix by a hash of their id, rearranged, and put back together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Units that tile any text: lines with their line feed, and a last one without. One class of characters after another, so
#: that the matcher loops and never recurses, however long a line is.
LINES = r"[^\n]*\n|[^\n]+"
#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")


def _checked(sentinels: tuple[str, str, str]) -> None:
    """Raises unless an output can be parsed without doubt: no sentinel is empty or within another, and none begins as one
    ends, so that none can arise where a text meets a sentinel."""
    for i, s in enumerate(sentinels):
        for j, t in enumerate(sentinels):
            if not s or i != j and s in t or any(s[-k:] == t[:k] for k in range(1, min(len(s), len(t)) + (i != j))):
                raise ValueError(f"sentinels {s!r} and {t!r} can't be told apart in an output")


def _either(sentinels: tuple[str, str, str]) -> str:
    return "|".join("".join(f"\\x{{{ord(c):x}}}" for c in s) for s in sentinels)


def fill_in_middle(
    docs: DataFrame,
    seed: int = 7,
    percent: int = 100,
    spm_percent: int = 50,
    unit: str = LINES,
    sentinels: tuple[str, str, str] = SENTINELS,
    text_col: str = "text",
    id_col: str = "doc_id",
) -> DataFrame:
    """docs plus n_units, form, prefix_chars, middle_chars and output (replacing columns of those names).

    A text is the matches of ``unit`` one after another, so the pattern must leave out no character. The first four groups of
    eight hex digits of sha256("seed:id") decide: the prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1)
    units, the middle after the larger, the rest is the suffix; h3 % 100 under ``percent`` rearranges at all, h4 % 100
    under ``spm_percent`` puts the suffix first. Form plain: the text itself (empty, holding a sentinel, or not drawn);
    psm: <P>prefix<S>suffix<M>middle; spm: <S>suffix<P>prefix<M>middle. Characters are code points, null where plain.
    Null text counts as empty, a null id as no digits. Each row stands for itself (repeated rows come out alike); nothing
    is shuffled.
    """
    _checked(sentinels)
    text, own = F.coalesce(F.col(text_col), F.lit("")), ["__fim_digest", "__fim_units", "__fim_a", "__fim_b", "__fim_parts"]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    drawn = lambda k: F.conv(F.substring("__fim_digest", 8 * k - 7, 8), 16, 10).cast("long")
    out = docs.withColumns({"__fim_digest": digest, "__fim_units": F.regexp_extract_all(text, F.lit(unit), F.lit(0))})
    out = out.withColumn("n_units", F.size("__fim_units").cast("long"))
    ends = [drawn(k) % (F.col("n_units") + 1) for k in (1, 2)]
    out = out.withColumns({"__fim_a": F.least(*ends).cast("int"), "__fim_b": F.greatest(*ends).cast("int")})
    taken = lambda start, n: F.array_join(F.slice("__fim_units", start, n), "")
    a, b = F.col("__fim_a"), F.col("__fim_b")
    parts = F.struct(taken(F.lit(1), a).alias("p"), taken(a + 1, b - a).alias("m"), taken(b + 1, F.size("__fim_units") - b).alias("s"))
    held = F.lit(False)
    for s in sentinels:
        held = held | F.contains(text, F.lit(s))
    plain = (text == "") | held | (drawn(3) % 100 >= percent)
    form = F.when(plain, "plain").when(drawn(4) % 100 < spm_percent, "spm").otherwise("psm")
    out = out.withColumns({"form": form, "__fim_parts": parts})
    before_prefix, before_suffix, before_middle = map(F.lit, sentinels)
    p, m, s = (F.col("__fim_parts")[c] for c in "pms")
    psm, spm = F.concat(before_prefix, p, before_suffix, s, before_middle, m), F.concat(before_suffix, s, before_prefix, p, before_middle, m)
    cut = lambda c: F.when(F.col("form") != "plain", F.length(c).cast("long"))
    arranged = F.when(F.col("form") == "plain", text).when(F.col("form") == "spm", spm).otherwise(psm)
    return out.withColumns({"prefix_chars": cut(p), "middle_chars": cut(m), "output": arranged}).drop(*own)


def restored(output: Column | str, form: Column | str, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text again, from an output and its form alone: the output is parsed at its sentinels. Null where either is null
    or an output that isn't plain lacks one of the three."""
    _checked(sentinels)
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, _either(sentinels), -1)  # nothing, then the two parts in their order, then the middle
    first, second, middle = (F.get(parts, k) for k in (1, 2, 3))
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("n_units").alias("n"),
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored("output", "form"), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM cut),
ends AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM ends),
made AS (
  SELECT doc_id, n, form, length(p) AS np, length(m) AS nm,
         CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m
                   ELSE '<P>' || p || '<S>' || s || '<M>' || m END AS o FROM parts),
parsed AS (
  SELECT *, split_part(o, '<M>', 2) AS mid, split_part(split_part(o, '<M>', 1), '<S>', 2) AS after_s, split_part(split_part(o, '<M>', 1), '<P>', 2) AS after_p FROM made)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN np::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN nm::BIGINT END AS middle_chars,
       sha256(o) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN o WHEN 'spm' THEN after_p || mid || split_part(after_s, '<P>', 1)
                        ELSE split_part(after_p, '<S>', 1) || mid || after_s END) AS restored_sha256
FROM parsed
"""
