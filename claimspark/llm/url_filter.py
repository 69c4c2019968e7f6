"""URL filter: allow and block rules by host and path, else a weighted vocabulary matched by Aho-Corasick.

Null urls, or those without ``://``, have an empty host and path; the vocabulary sees the whole url (null: empty), so
they are judged like any other. Repeated rows are judged alike. Columns of the input that clash with the results
stay out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from claimspark.llm.common import table

#: (term, weight): one of weight ``STRICT`` anywhere at word boundaries rejects the url; of the others distinct ones do whose
#: weights reach ``REJECT_FROM``, which no single one does. English, German, French, Spanish.
STRICT, REJECT_FROM = 9, 3
TERMS = (
    *((t, STRICT) for t in ("porn", "porno", "xxx", "hentai", "milf", "camgirls", "escorts", "viagra", "cialis", "warez", "malware", "phishing", "sexkontakte", "putas", "tragaperras")),
    *((t, 2) for t in ("adult", "sex", "nude", "erotik", "erotico", "sexe", "casino", "kasino", "poker", "roulette", "bet", "bets", "betting", "wetten", "paris-sportifs", "apuestas", "gambling", "slots", "loan", "loans", "kredit", "pills", "pillen", "dating", "torrent", "crack", "keygen", "lottery", "jackpot", "spam", "ads", "adserver", "popunder")),
    *((t, 1) for t in ("x", "hot", "girls", "cam", "win", "bonus", "cheap", "free", "gratis", "gratuit", "billig", "farm", "track", "tracker", "click", "deal", "deals", "cash", "hack", "download")),
)
#: (host, path, verdict): the longest that fits decides.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path) of a url; both empty without ``://``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for c in "/?#" if (i := rest.find(c)) >= 0]
    at = min(ends, default=len(rest))
    host, tail = rest[:at], rest[at:]
    ends = [i for c in "?#" if (i := tail.find(c)) >= 0]
    return host.encode().lower().decode(), tail[: min(ends, default=len(tail))]


class Vocabulary:
    """Weighted terms in one automaton. A hit counts where no ASCII letter or digit touches it."""

    def __init__(self, terms: Sequence[tuple[str, int]], strict: int = STRICT) -> None:
        import ahocorasick

        self.automaton, self.strict = ahocorasick.Automaton(), strict
        for term, weight in terms:
            self.automaton.add_word(term, (term, weight))
        if terms:
            self.automaton.make_automaton()
        self.any = bool(terms)

    def hits(self, url: str | None) -> tuple[dict[str, int], dict[str, int]]:
        """(strict, soft) terms found and their weights."""
        text = (url or "").lower()
        found: dict[str, int] = {}
        if text and self.any:
            touches = lambda i: 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()
            for end, (term, weight) in self.automaton.iter(text):
                if not touches(end + 1) and not touches(end - len(term)):
                    found[term] = weight
        return {t: w for t, w in found.items() if w >= self.strict}, {t: w for t, w in found.items() if w < self.strict}


def rule_for(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """(rule text, verdict) of the longest rule that fits; rules: by host, longest path first."""
    best = None
    at = 0
    while host:
        for rule_path, verdict in rules.get(host[at:], ()):
            if path.startswith(rule_path):
                text = host[at:] + rule_path
                if best is None or len(text) > len(best[0]):
                    best = text, verdict
                break
        at = host.find(".", at) + 1
        if not at:
            break
    return best


def filter_urls(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    terms: Sequence[tuple[str, int]] = TERMS,
    strict: int = STRICT,
    reject_from: int = REJECT_FROM,
) -> DataFrame:
    """(id, host, path, rule, verdict, strict_hits, soft_hits) of each row, in one pass without a shuffle."""
    by_host: dict[str, list[tuple[str, str]]] = {}
    for host, path, verdict in sorted(rules, key=lambda r: -len(r[1])):
        by_host.setdefault(host, []).append((path, verdict))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Vocabulary(terms, strict)
        for batch in batches:
            rows = []
            for i, url in zip(batch["i"], batch["u"], strict=True):
                url = None if not isinstance(url, str) else url
                host, path = split_url(url)
                fits = rule_for(host, path, by_host)
                bad, odd = words.hits(url)
                verdict = fits[1] if fits else "block" if bad or sum(odd.values()) >= reject_from else "allow"
                rows.append((i, host, path, fits and fits[0], verdict, ",".join(sorted(bad)), ",".join(sorted(odd))))
            yield pd.DataFrame(rows, columns=["i", "host", "path", "rule", "verdict", "strict_hits", "soft_hits"])

    kind = pages.schema[id_col].dataType.simpleString()
    slim = pages.selectExpr(f"`{id_col}` AS i", f"`{url_col}` AS u")
    out = slim.mapInPandas(judge, f"i {kind}, host string, path string, rule string, verdict string, strict_hits string, soft_hits string")
    return out.withColumnRenamed("i", id_col)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def _op9_sql() -> str:
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    words = ", ".join(f"('{t}', {w})" for t, w in TERMS)
    return f"""
WITH rules(rh, rp, rv) AS (VALUES {rules}),
words(w, weight) AS (VALUES {words}),
p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, coalesce(lower(url), '') AS u, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
fit AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
        FROM q JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
hit AS (SELECT page_id, list_sort(list(w) FILTER (weight >= {STRICT})) AS s, list_sort(list(w) FILTER (weight < {STRICT})) AS o, sum(weight) FILTER (weight < {STRICT}) AS soft
        FROM q JOIN words ON regexp_matches(u, '(^|[^a-z0-9])' || w || '($|[^a-z0-9])') GROUP BY page_id)
SELECT q.page_id, host, path, rule,
       coalesce(rv, CASE WHEN coalesce(len(s), 0) > 0 OR coalesce(soft, 0) >= {REJECT_FROM} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(array_to_string(s, ','), '') AS strict_hits, coalesce(array_to_string(o, ','), '') AS soft_hits
FROM q LEFT JOIN fit USING (page_id) LEFT JOIN hit USING (page_id)"""


ORACLE = {"op9_url_filter": _op9_sql()}
