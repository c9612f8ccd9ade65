"""URL filter: host rules first, then a weighted vocabulary whose terms an Aho-Corasick automaton finds."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallyforge.llm.common import ascii_lower, named, table, unused

#: (verdict, rule). A rule is a host and the beginning of a path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A url is rejected when the weights of its different terms come to this.
LIMIT = 3
#: Strict terms: one is enough.
STRICT = (
    "anal", "bdsm", "blowjob", "bukkake", "camgirl", "camgirls", "camsex", "crackz", "creampie", "cumshot", "deepthroat", "dildo", "gangbang", "hardcoresex",
    "hentai", "keygen", "keygens", "livesex", "milf", "onlinecasino", "onlinepharmacy", "orgy", "porn", "porno", "pornhub", "pornos", "pornstar", "pornstars",
    "sexcam", "sexchat", "sexshop", "shemale", "threesome", "viagra", "warez", "webcamsex", "xhamster", "xnxx", "xvideos", "xxx",
)
#: Soft terms by weight: it takes two, of which one says much, or three that say little.
SOFT = (
    *((t, 2) for t in (
        "adult", "affiliates", "baccarat", "bet", "betting", "bingo", "blackjack", "bookmaker", "casino", "casinos", "cialis", "crack", "cracked", "dating", "erotic",
        "escort", "escorts", "fetish", "forex", "gambling", "hookup", "jackpot", "levitra", "nude", "nudes", "payday", "pharmacy", "pills", "poker", "replica", "roulette",
        "sex", "sexy", "slots", "sportsbook", "spyware", "steroids", "torrent", "torrents", "tramadol", "xanax",
    )),
    *((t, 1) for t in (
        "adserver", "ads", "bonus", "buy", "cam", "cams", "cash", "cheap", "clickbait", "coupon", "deal", "deals", "discount", "doubleclick", "earn", "free", "girls",
        "hot", "loan", "loans", "lucky", "online", "offer", "offers", "popup", "prize", "promo", "sale", "singles", "spam", "track", "tracker", "tracking", "vip",
        "win", "winner",
    )),
)

VERDICT_TYPE = "rule string, verdict string, strict_hits int, soft_hits int, weight int"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or # or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[tuple[str, int], ...], limit: int):
    import ahocorasick

    built = ahocorasick.Automaton()
    for terms, kind in ((soft, "soft"), (tuple((t, limit) for t in strict), "strict")):  # a term in both lists is strict
        for term, weight in terms:
            built.add_word(term.lower(), (kind, term.lower(), weight))
    built.make_automaton()
    return built


def hits(url: str, strict: tuple[str, ...], soft: tuple[tuple[str, int], ...], limit: int = LIMIT) -> tuple[int, int, int]:
    """Different strict and soft terms of the url that no ASCII letter or digit touches on either side, and the sum of their weights."""
    if not (strict or soft):
        return 0, 0, 0
    text, found = url.translate(_LOWERED), set()
    for end, one in automaton(strict, soft, limit).iter(text):
        start = end - len(one[1]) + 1
        if not (start and text[start - 1] in _INNER) and not (end + 1 < len(text) and text[end + 1] in _INNER):
            found.add(one)
    n_strict = sum(kind == "strict" for kind, _, _ in found)
    return n_strict, len(found) - n_strict, sum(weight for _, _, weight in found)


_INNER = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWERED = {i: i + 32 for i in range(65, 91)}


class HostRules:
    """Looks a host up by each of its suffixes, so the time does not depend on the number of rules."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.by_host: dict[str, list[tuple[str, str, str]]] = defaultdict(list)
        for verdict, rule in rules:
            host, _, path = rule.partition("/")
            self.by_host[host].append((f"/{path}", rule, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits the host or a parent domain; of equally long ones the one with the longer host."""
        best, rest = None, host
        while True:
            for start, rule, verdict in self.by_host.get(rest, ()):
                if path.startswith(start) and (best is None or len(rule) > len(best[0])):
                    best = rule, verdict
            _, dot, rest = rest.partition(".")
            if not dot:
                return best or (None, None)


def judge_urls(df: DataFrame, url: str = "url", rules=RULES, strict=STRICT, soft=SOFT, limit: int = LIMIT) -> DataFrame:
    """Adds host, path, rule, verdict (allow or block), strict_hits, soft_hits and weight; columns of these names are replaced.

    ``soft`` has (term, weight); a strict term weighs ``limit``. Where no rule fits, a url is blocked if its different terms weigh
    ``limit`` or more together. A url without ``://``, an empty one and null have empty host and path; no rule fits them. Null has no
    terms, so it is allowed. Every row is judged by itself, so repeated rows get the same verdict and an empty table stays empty.
    """
    rules, strict, soft = tuple(map(tuple, rules)), tuple(strict), tuple(map(tuple, soft))
    made = ("host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight")

    @F.pandas_udf(VERDICT_TYPE)
    def judged(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known = HostRules(rules)
        for urls, hosts, paths in parts:
            rows = []
            for one, host, path in zip(urls, hosts, paths):
                rule, verdict = known.find(host, path)
                found = hits(one, strict, soft, limit) if isinstance(one, str) else (0, 0, 0)
                rows.append((rule, verdict or ("block" if found[2] >= limit else "allow"), *found))
            yield pd.DataFrame(rows, columns=list(made[2:]))

    kept = [named(c) for c in df.columns if c.lower() not in made]
    link, verdict = unused([*df.columns, *made], "url", "judged")
    out = df.select(*kept, named(url).alias(link), host_of(named(url)).alias("host"), path_of(named(url)).alias("path"))
    out = out.withColumn(verdict, judged(link, "host", "path"))
    return out.select(*kept, "host", "path", *(F.col(f"{verdict}.{c}").alias(c) for c in made[2:]))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def _oracle() -> str:
    lowered = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    held = lambda terms: f"CAST(len(list_filter([{', '.join(repr(t) for t in terms)}], lambda t: regexp_matches(lowered, '(^|[^a-z0-9])' || t || '($|[^a-z0-9])'))) AS INTEGER)"
    weights = sorted({w for _, w in SOFT})
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    fits = lambda rule: "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '/{1}')".format(*rule.split("/", 1))
    pick = " ".join(f"WHEN {fits(rule)} THEN '{rule}'" for _, rule in ordered)
    said = " ".join(f"WHEN rule = '{rule}' THEN '{verdict}'" for verdict, rule in ordered)
    return f"""
WITH parts AS (
  SELECT page_id, {lowered} AS lowered,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
counted AS (SELECT *, {held(STRICT)} AS strict_hits, {", ".join(f"{held([t for t, w in SOFT if w == k])} AS soft_{k}" for k in weights)} FROM parts),
ruled AS (SELECT *, CASE {pick} END AS rule, CAST({LIMIT} * strict_hits + {" + ".join(f"{k} * soft_{k}" for k in weights)} AS INTEGER) AS weight FROM counted)
SELECT page_id, host, path, rule,
  CASE {said} WHEN weight >= {LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
  strict_hits, {" + ".join(f"soft_{k}" for k in weights)} AS soft_hits, weight
FROM ruled"""


ORACLE = _oracle()
