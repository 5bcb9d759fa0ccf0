"""URL filters: host and path rules first, then a weighted vocabulary found by an Aho-Corasick automaton.

The vocabulary is a table of terms and weights (:func:`vocabulary_of` reads one, of ``MOST_TERMS`` terms at most): one strict term rejects, and so do distinct soft
ones whose weights add up to ``SOFT_HITS``. Without a table there are a few terms, each soft one of weight 1. Terms are
looked for in the whole url, percent-decoded and lower-cased, and count where no letter or digit touches them. The automaton is built once a task, from what was
broadcast once.

Defined cases: a null url has an empty host and path, no rule and no hit, so its verdict is ``allow``; one without ``://``
has an empty host and path and no rule, and its verdict is the vocabulary's. A term counts once, however often it stands in a
url; of rules that fit equally long, the first by host and path wins. Urls are read whole, in time proportional to their length.
Repeated rows are judged each on its own; an empty table gives an empty table; other columns of the input are ignored by
:func:`judge_urls` and kept by :func:`keep_allowed`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: (host, path, verdict)
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: One hit rejects.
STRICT = tuple(
    "porn porno pornhub xxx hentai milf escort escorts camgirl camgirls casino viagra cialis levitra pills steroids spam malware phishing ransomware"
    " keylogger warez keygen serialz cracked nulled carding fullz gore".split()
)
#: Several distinct hits reject.
SOFT = tuple(
    "win winner free freebies cheap cheapest bet bets betting gamble gambling slots jackpot lottery lotto poker roulette bingo sex sexy adult nude nudes"
    " erotic fetish hookup farm loan loans payday mortgage refinance crack torrent torrents replica replicas deals coupon coupons bonus click clickbait"
    " affiliate earn cash crypto airdrop forex pharmacy pharma weightloss diet detox miracle cure backlinks hacked exploit".split()
)
SOFT_HITS = 2
#: Terms of a vocabulary, which is broadcast: some hundred megabytes as an automaton.
MOST_TERMS = 1_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Terms that reject alone, and those that do together, with their weights."""

    strict: frozenset[str]
    soft: dict[str, float]

    @staticmethod
    def of(strict=STRICT, soft=SOFT) -> Vocabulary:
        return Vocabulary(frozenset(strict), dict.fromkeys(soft, 1.0))


def vocabulary_of(terms: DataFrame) -> Vocabulary:
    """The vocabulary of a table (term, strict boolean, weight double). Terms are lower-cased; empty and null ones, and soft ones without a weight above 0, are left out;
    of a term given twice strict wins, then the highest weight."""
    clean = terms.select(F.lower("term").alias("term"), F.coalesce("strict", F.lit(False)).alias("strict"), F.coalesce("weight", F.lit(0.0)).cast("double").alias("weight"))
    clean = clean.where("term <> '' and (strict or weight > 0)").groupBy("term").agg(F.max("strict").alias("strict"), F.max("weight").alias("weight"))
    rows = clean.limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a vocabulary has {MOST_TERMS} terms at most")
    return Vocabulary(frozenset(r["term"] for r in rows if r["strict"]), {r["term"]: r["weight"] for r in rows if not r["strict"]})


def compile_rules(rules) -> list[tuple[str, str, str, str]]:
    """Longest first, so that the first fitting rule wins: by host, then by path."""
    return sorted(((h, p, h + p, v) for h, p, v in rules), key=lambda r: (-len(r[2]), r[2]))


def verdict_of(url: Column | str, rules=RULES, strict=STRICT, soft=SOFT, soft_hits: float = SOFT_HITS, vocabulary: Vocabulary | None = None) -> Column:
    """struct<host, path, rule, verdict, n_strict, n_soft> of a url column. ``vocabulary`` stands for ``strict`` and ``soft``."""
    ranked = compile_rules(rules)
    held = SparkSession.active().sparkContext.broadcast(vocabulary or Vocabulary.of(strict, soft))

    @F.pandas_udf("host string, path string, rule string, verdict string, n_strict int, n_soft int")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        words, automaton = held.value, ahocorasick.Automaton()
        for term in (*words.soft, *words.strict):
            automaton.add_word(term, term)
        automaton.make_automaton()

        def hits(text: str) -> tuple[int, int, float]:
            found: set[str] = set()
            for end, term in automaton.iter(text) if len(automaton) else ():
                start = end - len(term) + 1
                before, after = text[start - 1 : start], text[end + 1 : end + 2]
                if not (before.isalnum() or after.isalnum()):
                    found.add(term)
            strict_ones = len(found & words.strict)
            return strict_ones, len(found) - strict_ones, sum(sorted(words.soft[t] for t in found if t not in words.strict))

        def judge(url: str | None):
            host, path = split_url(url)
            rule = next((r for r in ranked if fits(r, host, path)), None)
            n_strict, n_soft, weight = hits(unquote(url or "").lower())
            method = "block" if n_strict >= 1 or weight >= soft_hits else "allow"
            return host, path, rule and rule[2], rule[3] if rule else method, n_strict, n_soft

        for urls in batches:
            yield pd.DataFrame([judge(u) for u in urls], columns=["host", "path", "rule", "verdict", "n_strict", "n_soft"])

    return judged(url)


def judge_urls(pages: DataFrame, **how) -> DataFrame:
    """page_id, host, path, rule, verdict, n_strict, n_soft for each row of ``pages`` (page_id, url)."""
    return pages.select("page_id", verdict_of("url", **how).alias("found")).select("page_id", "found.*")


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path of a url; both empty where there is no ``://``."""
    scheme, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[:end]


def fits(rule: tuple[str, str, str, str], host: str, path: str) -> bool:
    return (host == rule[0] or host.endswith("." + rule[0])) and path.startswith(rule[1])


def keep_allowed(pages: DataFrame, **how) -> DataFrame:
    """The rows of ``pages`` whose own url is allowed, with all their columns."""
    return pages.where(verdict_of("url", **how)["verdict"] == "allow")
