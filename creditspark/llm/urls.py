"""URL filter: host and path rules, then a weighted vocabulary counted by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creditspark.llm.text import LOWER, UPPER, lower_ascii

#: One of these rejects a url.
STRICT = (
    "porn", "porno", "xxx", "hentai", "nsfw", "camgirls", "sexcam", "escorts", "phishing", "malware", "warez",
    "keygen", "botnet", "cryptominer",
)
#: Several different ones of these reject a url.
SOFT = (
    "adult", "sex", "nude", "casino", "poker", "betting", "jackpot", "slots", "viagra", "pills", "torrent", "crack",
    "pirate", "gore", "hacked", "spam", "proxy", "loan", "lottery", "dating",
)
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
Rule = tuple[str, str, str]


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://` or for null."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def vocabulary_hits(strict: Sequence[str], soft: Sequence[str]):
    """Pandas UDF: how often strict terms occur in a url and how many different soft terms do.

    A term counts where neither neighbour is an ASCII letter or digit. One pass of
    the automaton finds all terms; null has none.
    """
    weights = {**{t: 0 for t in soft}, **{t: 1 for t in strict}}

    @F.pandas_udf("strict_hits int, soft_terms int")
    def hits(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find = ahocorasick.Automaton()
        for term, is_strict in weights.items():
            find.add_word(term, (len(term), is_strict, term))
        find.make_automaton()
        lower = str.maketrans(UPPER, LOWER)
        for series in urls:
            rows = []
            for url in series:
                u = url.translate(lower) if url else ""
                n, seen = 0, set()
                for end, (length, is_strict, term) in find.iter(u):
                    start = end - length + 1
                    if (start and u[start - 1] in LETTERS) or (end + 1 < len(u) and u[end + 1] in LETTERS):
                        continue
                    if is_strict:
                        n += 1
                    else:
                        seen.add(term)
                rows.append((n, len(seen)))
            yield pd.DataFrame(rows, columns=["strict_hits", "soft_terms"])

    return hits


def url_verdicts(
    pages: DataFrame, rules: Sequence[Rule] = (), strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT,
    soft_limit: int = 2, url: str = "url",
) -> DataFrame:
    """Every row with `host`, `path`, `rule`, `verdict`, `strict_hits` and `soft_terms`.

    A rule (verdict, host, path) fits its host and all subdomains when the path
    starts with the rule's; the longest rule decides. Elsewhere the vocabulary
    decides: one strict term, or `soft_limit` different soft ones, block.

    Null and urls without `://` have empty host and path, so no rule fits them;
    null holds no terms and is allowed. Rows are judged one by one: repeated rows
    repeat their verdict, and an empty table gives an empty one. Columns of the
    input that have the name of a result are replaced by it.
    """
    link = F.col(f"`{url}`")
    named = pages.select(
        *[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict", "strict_hits", "soft_terms", "__hits")],
        url_host(link).alias("host"), url_path(link).alias("path"), vocabulary_hits(strict, soft)(link).alias("__hits"),
    )
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        at = (F.col("host") == host) | F.col("host").endswith("." + host)
        fits = at & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, decision).otherwise(verdict)
    bad = (F.col("__hits.strict_hits") > 0) | (F.col("__hits.soft_terms") >= soft_limit)
    return named.select(
        *[c for c in named.columns if c != "__hits"], rule.alias("rule"),
        F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias("verdict"),
        F.col("__hits.strict_hits").alias("strict_hits"), F.col("__hits.soft_terms").alias("soft_terms"),
    )


def verdict_sql(rules: Sequence[Rule], strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = 2) -> str:
    """The same verdicts over `pages` in SQL, with one regular expression for each term."""
    ordered: Mapping = {h + p: (v, h, p) for v, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2]))}
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    has = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])')"
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{r}'" for r, (_, h, p) in ordered.items()) + " END"
    given = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, (v, _, _) in ordered.items()) + " END"
    soft_sum = " + ".join(f"{has(t)}::INT" for t in soft)
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS u,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages), ruled AS (SELECT *, {rule} AS rule FROM parts)
SELECT page_id, host, path, rule,
       coalesce({given}, CASE WHEN {" OR ".join(has(t) for t in strict)} OR ({soft_sum}) >= {soft_limit}
                              THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled"""
