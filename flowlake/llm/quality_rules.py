"""Line-first cleaning of documents, with DataFrame functions only.

Each line is judged by rules of punctuation, navigation and boilerplate; failing lines are removed; a document
that loses too much of its text is rejected. No row leaves its partition: the plan has no shuffle.

Null and blank texts have no words: all counts are 0, base_failed is true, kept false. Repeated rows and ids, null ones too, are
judged one by one; texts of any length whole, in time near linear in their length. Columns of the input with the names of results are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import let, shingle_hashes, table, words

# Phrases of page furniture in English, German, French and Spanish; they count as whole words, in short lines only.
BOILERPLATE = (
    "cookie", "cookies", "javascript", "all rights reserved", "terms of use", "terms of service", "privacy policy", "sign up", "log in", "sign in", "subscribe", "newsletter", "click here", "read more", "share this", "lorem ipsum", "powered by",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "impressum", "anmelden", "registrieren", "hier klicken", "mehr lesen", "weiterlesen",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "conditions d'utilisation", "se connecter", "s'inscrire", "cliquez ici", "lire la suite",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "términos de uso", "iniciar sesión", "regístrate", "haga clic aquí", "leer más",
)
_FURNITURE = r"(^|[^\p{L}\p{N}])(" + "|".join(BOILERPLATE) + r")([^\p{L}\p{N}]|$)"
#: What a line may end with.
ENDS = (".", "!", "?", "…", ":", ";", '"', "'", "”", "’", ")", "]")


def _repeat_words(w: Column, width: int = 5) -> Column:
    """Words in windows that occur twice or more. Windows are compared by 64-bit hashes; texts without repeats stop at a distinct count."""
    hashes = shingle_hashes(w, width)

    def covered(h: Column) -> Column:
        ranked = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(r: Column) -> Column:
            same = lambda i, j: F.get(r, i)["h"] == F.get(r, j)["h"]
            twice = F.filter(F.transform(r, lambda x, i: F.when(F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False)), x["i"])), lambda p: p.isNotNull())
            return let(F.sort_array(twice), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(width)), F.lit(width))), F.lit(0), lambda a, x: a + x))

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ranked, positions))

    return F.when(F.size(w) < width + 1, F.lit(0)).otherwise(let(hashes, covered)).cast("long")


def _line(line: Column, bare: Column, short: int) -> Column:
    """(words, ok) of a line; blank lines have none and are ok."""
    w = words(bare)

    def judged(n: Column) -> Column:
        loud = F.regexp_count(bare, F.lit(r"[!?]{2,}"))
        symbols = F.regexp_count(bare, F.lit(r"[#*$%&<>]{2,}"))
        bars = F.regexp_count(bare, F.lit(r"[|›»•·]"))
        marked = F.when(bare.rlike(r"[|›»•·]|[!?]{2}|[#*$%&<>]{2}"), (loud * 5 > n) | (symbols * 5 > n) | ((bars >= 3) & (bars * 5 > n))).otherwise(F.lit(False))
        stub = (n < 3) & (n > 0) & ~F.substring(bare, -1, 1).isin(*ENDS)
        furniture = F.when(n <= short, F.lower(bare).rlike(_FURNITURE)).otherwise(F.lit(False))
        return F.struct(n.alias("n"), (~(marked | stub | furniture)).alias("ok"), line.alias("line"))

    return let(F.size(w), judged)


def clean_lines(docs: DataFrame, text: str = "text", min_kept: float = 0.5, min_words: int = 10, max_repeat_pct: int = 20, short_line: int = 12) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, lost_words and clean_text.

    kept: not base_failed, and the lines that pass hold at least min_kept of the words.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.split(t, "\n", -1)
    body = F.filter(lines, lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    facts = lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(body, lambda b: F.size(b) - F.size(F.array_distinct(b))).cast("long").alias("n_dup_lines"),
        _repeat_words(w).alias("n_repeat_words"),
        F.transform(lines, lambda x: _line(x, F.btrim(x, F.lit(" \t\n\x0b\x0c\r")), short_line)).alias("lines"),
    )
    fresh = [c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words", "clean_text", "__f")]
    good = F.filter("__f.f.lines", lambda x: x["ok"])
    # The partition's number makes the struct non-deterministic to the optimiser, which else moves a later filter on kept
    # below it and evaluates it once for every field.
    out = docs.select(*fresh, F.struct(let(words(F.col(text)), facts).alias("f"), F.spark_partition_id().alias("p")).alias("__f"))
    out = out.select(
        *fresh, *[F.col(f"__f.f.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        F.aggregate(F.filter("__f.f.lines", lambda x: ~x["ok"]), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("lost_words"),
        F.array_join(F.transform(good, lambda x: x["line"]), "\n").alias("clean_text"),
    )
    bad = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    return out.withColumns({"base_failed": bad, "kept": ~bad & (F.col("lost_words") <= (1 - min_kept) * F.col("n_words"))})


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = clean_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_words")


QUERIES = {"op8_quality_rules": op8_quality_rules}
_W = r"[^\x20\x09-\x0D]+"
_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_Q = lambda t: t.replace("'", "''")
SQL = {
    "op8_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT r, regexp_extract_all(t, '{_W}') AS ws FROM d),
w AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM a),
g AS (SELECT r, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g, lead(x, 4) OVER o IS NOT NULL AS ok FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g WHERE ok),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM c, (SELECT unnest(range(5)) AS k) WHERE n > 1 GROUP BY r),
x AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
l AS (SELECT r, line, trim(line, {_BLANK}) AS b, len(regexp_extract_all(line, '{_W}')) AS n FROM x),
j AS (SELECT r, line, n, (regexp_matches(b, '[|›»•·]|[!?]{{2}}|[#*$%&<>]{{2}}') AND (len(regexp_extract_all(b, '[!?]{{2,}}')) * 5 > n OR len(regexp_extract_all(b, '[#*$%&<>]{{2,}}')) * 5 > n
        OR len(regexp_extract_all(b, '[|›»•·]')) >= 3 AND len(regexp_extract_all(b, '[|›»•·]')) * 5 > n))
      OR n BETWEEN 1 AND 2 AND right(b, 1) NOT IN ({", ".join(f"'{_Q(e)}'" for e in ENDS)}) OR n <= 12 AND regexp_matches(lower(b), '{_Q(_FURNITURE)}') AS bad FROM l),
s AS (SELECT r, count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup, coalesce(sum(n) FILTER (bad), 0) AS lost FROM j GROUP BY r),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(dup AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, CAST(lost AS BIGINT) AS lost_words FROM d JOIN a USING (r) JOIN s USING (r) LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND lost_words <= 0.5 * n_words AS kept FROM b"""
}
