"""URL filters: host rules first, then host word segmentation and naive Bayes.

The longest rule that fits decides. For other urls the names in host and path are split into words by unigram
Viterbi and multinomial naive Bayes, fitted to labelled names, scores the words.

The words of the segmenter are those of the labelled names. ``learn_words`` adds to them, where asked, names that stand alone in the urls of
several hosts of a table. Those with more than a ``WORDS``-th of all such names are kept, which are
fewer than ``WORDS`` whatever the input, so they may be sent to every task.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.llm.common import cut, slices

#: Fixed values: (action, host, path) rules of the registered query.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

#: Words of names of unwanted sites, by subject, and of others. A word that is in both lists says little.
UNWANTED = (
    "bet bets betting bookmaker casino poker roulette blackjack slots jackpot lottery bingo gamble gambling wager spins bonus "
    "adult porn porno sex sexy xxx nude naked cams webcam escort erotic hookup milf fetish hentai hot "
    "pills viagra cialis meds tramadol steroids pharmacy slimming detox miracle enlargement cheap discount replica fake counterfeit "
    "spam scam phishing fraud hoax clickbait bulk leads backlinks doorway parked "
    "ads ad advert adverts adserver advertising tracker tracking pixel banner popup popunder clicks affiliate sponsor impressions "
    "malware spyware trojan ransomware keylogger crack cracked warez keygen serials torrent pirate piracy hack cheats nulled "
    "loans payday lender debt forex doubler ponzi investment cash fast quick rich money earn "
    "win winner prize prizes giveaway free iphone gift cards survey lucky instant track farm farms"
).split()
WANTED = (
    "news daily weekly times herald journal press review magazine world local city town county state national public open free "
    "science research institute laboratory university college school academy learning education course lectures library archive museum history art gallery "
    "health hospital clinic medical care pharmacy government council parliament court law police fire service office agency department "
    "weather travel guide map maps train bus flight hotel garden home house kitchen food recipes cooking restaurant coffee bakery farm market shop store books music film theatre "
    "sports football tennis cycling running hiking club team league track field video photo radio podcast "
    "software code data project source docs manual wiki forum help support developer engineering network security cloud design studio community church charity foundation "
    "business finance bank insurance energy water environment nature forest ocean river mountain animal birds flower family children parents"
).split()
#: Host labels and path parts that say nothing.
COMMON = frozenset("www m blog com org net example en de fr es html htm php index".split())
#: Added to the count of every word in a class. A labelled word stands for many names, so one that is in one list alone outweighs the prior.
SMOOTH = 0.1
#: Learned words are fewer than this.
WORDS = 100_000


class Segmenter:
    """Unigram Viterbi: the likeliest split of a name into words; letters outside words pay a fixed price each."""

    def __init__(self, counts: dict[str, int], unknown: float = -9.0) -> None:
        total = sum(counts.values()) + 1
        self.logp = {w: math.log(c / total) for w, c in counts.items()}
        self.longest = max(map(len, counts), default=1)
        self.unknown = unknown

    def __call__(self, name: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for e in range(1, len(name) + 1):
            options = [(best[e - 1][0] + self.unknown, e - 1)]
            options += [(best[a][0] + self.logp[name[a:e]], a) for a in range(max(0, e - self.longest), e) if name[a:e] in self.logp]
            best.append(max(options))
        cuts, e = [], len(name)
        while e:
            cuts.append((best[e][1], e))
            e = best[e][1]
        words: list[str] = []
        loose = ""
        for a, e in reversed(cuts):  # loose letters in a row make one unknown word
            if name[a:e] in self.logp:
                if loose:
                    words.append(loose)
                    loose = ""
                words.append(name[a:e])
            else:
                loose += name[a:e]
        return [*words, loose] if loose else words


class NaiveBayes:
    """Multinomial, ``smooth`` added to each count; words never seen in training are left out."""

    def __init__(self, samples: list[tuple[str, bool]], prior: float = 0.2, smooth: float = 1.0) -> None:
        self.smooth = smooth
        self.counts = {True: {}, False: {}}
        for text, bad in samples:
            for w in text.split():
                self.counts[bad][w] = self.counts[bad].get(w, 0) + 1
        self.words = set(self.counts[True]) | set(self.counts[False])
        self.total = {k: sum(c.values()) + smooth * len(self.words) for k, c in self.counts.items()}
        self.base = math.log(prior / (1 - prior))

    def odds(self, words: list[str]) -> float:
        """Log-odds that a name of these words is unwanted."""
        s = self.base
        for w in words:
            if w in self.words:
                s += math.log((self.counts[True].get(w, 0) + self.smooth) / self.total[True]) - math.log((self.counts[False].get(w, 0) + self.smooth) / self.total[False])
        return s


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :], re.S)
    return re.sub("[A-Z]+", lambda x: x[0].lower(), m[1]), m[2]


def rule_for(host: str, path: str, rules=RULES) -> tuple[str, str] | None:
    """The longest fitting rule as ``(spelling, action)``."""
    fits = [(len(h) + len(p), h + p, action) for action, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else None


def names_of(host: str, path: str) -> list[str]:
    """The names of letters, of any script, in a url, in lower case."""
    return [x for x in re.split(r"[\W\d_]+", f"{host} {path}".lower()) if x and x not in COMMON]


def learn_words(pages: DataFrame, *, url_column: str = "url", least_hosts: int = 3) -> dict[str, int]:
    """Names that stand alone in the urls of at least ``least_hosts`` hosts, with the numbers of hosts; null urls have none. Fewer than ``WORDS`` are returned."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, "url"):
                seen = set()
                for u in b.column("url").to_pylist():
                    host, path = split_url(u)
                    seen.update((host, x) for x in names_of(host, path) if 3 <= len(x) <= 24)
                hosts, names = zip(*seen, strict=True) if seen else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(names, pa.string())], names=["host", "name"])

    seen = pages.select(F.col(f"`{url_column}`").cast("string").alias("url")).mapInArrow(run, "host string, name string").distinct()
    counted = cut(seen.groupBy("name").agg(F.count(F.lit(1)).alias("n")))
    every = counted.agg(F.sum("n")).first()[0] or 0
    return {r["name"]: r["n"] for r in counted.filter((F.col("n") >= least_hosts) & (F.col("n") * WORDS > every)).collect()}


class Judge:
    def __init__(self, rules=RULES, samples: list[tuple[str, bool]] | None = None, counts: dict[str, int] | None = None) -> None:
        samples = samples if samples is not None else [(x, True) for x in UNWANTED] + [(x, False) for x in WANTED]
        self.rules, self.bayes = rules, NaiveBayes(samples, smooth=SMOOTH)
        own: dict[str, int] = {}
        for text, _ in samples:
            for w in text.split():
                own[w] = own.get(w, 0) + 2
        plain = Segmenter({w: c for w, c in own.items() if len(w) > 1})
        words = dict(own)
        for w, c in (counts or {}).items():
            if w in own or any(x not in own for x in plain(w)):  # names made of known words are none themselves
                words[w] = words.get(w, 0) + c
        self.segment = Segmenter({w: c for w, c in words.items() if len(w) > 1})
        self.words = lru_cache(maxsize=100_000)(lambda name: tuple(self.segment(name)))

    def tokens(self, host: str, path: str) -> list[str]:
        names = names_of(host, path)
        return [w for x in names for w in ((x,) if x in self.bayes.words else self.words(x))]

    def __call__(self, url: str | None) -> tuple[str, str, str | None, str, float]:
        host, path = split_url(url)
        odds = self.bayes.odds(self.tokens(host, path))
        rule = rule_for(host, path, self.rules)
        return host, path, rule and rule[0], rule[1] if rule else "block" if odds > 0 else "allow", odds


def judge(pages: DataFrame, *, rules=RULES, samples: list[tuple[str, bool]] | None = None, counts: dict[str, int] | None = None, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``page_id, host, path, rule, verdict, log_odds`` for every row.

    ``samples`` are labelled names, the words of each joined by spaces (those of this module if not given); ``counts`` are words besides, as ``learn_words`` gives them
    (none if not given). Words in neither list say nothing; words in both say little. Of rules of equal length the one that comes last in order of spelling is taken; log-odds of 0 allow. Null urls have empty host
    and path and no words; extra columns, repeated and null ids are fine; an empty table gives no rows; a url of any length is read whole.
    """
    sent = pages.sparkSession.sparkContext.broadcast(counts or {})  # fewer than WORDS words of 24 letters at most

    def rate(batches):
        j = Judge(rules, samples, sent.value)
        for b in batches:
            got = [j(u) for u in b.column("url").to_pylist()]
            columns = list(zip(*got, strict=True)) if got else [()] * 5
            yield pa.RecordBatch.from_arrays([b.column("page_id"), *(pa.array(c, k) for c, k in zip(columns, [pa.string()] * 4 + [pa.float64()], strict=True))], names=schema.names)

    named = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).cast("string").alias("url"))
    schema = T.StructType([named.schema["page_id"], *(T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")), T.StructField("log_odds", T.DoubleType())])
    return named.mapInArrow(rate, schema)
