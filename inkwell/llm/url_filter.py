"""URL filters: rules by host and path, and a logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled URL table (a list of
url, blocked); its size is bounded by what the caller passes. It is applied to
batches of URLs on the executors.
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import of_row, packed, unpacked

#: (verdict, rule): host, then path. Fixed values of the query's contract.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]

#: The labelled URLs, by topics: (blocked, space-separated URLs without scheme). No host of the test tables is among them.
LABELLED = [
    (1, "adult-videos.test/en/1 www.adult-clips.test/de/2 adults-only.test/fr/3 adultcams.test/a hot-adult-chat.test/en m.adult-zone.test/es/9 free-adult.test/clip adult.test/x"),
    (1, "grand-casino.test/en/4 best-casino.test/de/5 www.casino-royal.test/fr m.casinobonus.test/es/2 online-casino-slots.test/en casino-lounge.test/play blog.casino-tips.test/en/8"),
    (1, "diet-pills.test/en/6 www.buy-pills.test/de m.pills-online.test/fr/7 pharma-pills.test/es/8 cheap-meds.test/en/9 cheap-viagra.test/en cheap-pharmacy.test/buy"),
    (1, "live-bets.test/en/1 sports-bets.test/de/2 www.bets-now.test/fr m.best-bets.test/es/3 betting-bets.test/en free-spins.test/en/4 free-money.test/en"),
    (1, "spam-mails.test/en/3 www.spam-links.test/de/4 seo-spam.test/fr m.spambot.test/es link-farm.test/en/5 like-farm.test/en content-farm.test/en/6"),
    (1, "ads-pixel.test/en/2 www.ads-server.test/de m.ad-clicks.test/fr/3 pop-ads.test/es/4 click-track.test/en user-track.test/en/7 ads.test/banner web-tracking.test/px"),
    (0, "news.test/en/1 www.newspaper.test/de/2 m.daily-news.test/fr/3 blog.worldnews.test/es/4 weather.test/en/5 www.weather-today.test/en travel.test/de/7 blog.travel.test/fr"),
    (0, "school.test/en/2 www.university.test/de/4 m.library.test/fr/8 blog.science.test/es/1 history.test/en/6 museum.test/de www.physics-notes.test/en/2 math.test/fr/9"),
    (0, "recipes.test/en/3 www.cooking.test/de/5 m.garden.test/fr/7 blog.kitchen.test/es/2 music.test/en/8 guitar-lessons.test/en football.test/de/1 www.cinema.test/fr/4"),
    (0, "blog.test/en/4 www.site.test/de/8 m.home.test/fr/2 page.test/es/6 docs.test/en/guide wiki.test/en/article forum.test/de/thread www.shop.test/fr/books m.books.test/es"),
    (0, "health.test/en/6 www.doctor.test/de/9 m.hospital.test/fr bank.test/en/3 www.insurance.test/de city.test/en/8 blog.mountain.test/fr/5 train.test/es/7 www.radio.test/en/9"),
    (1, "poker-jackpot.invalid/en www.lucky-slots.invalid/play/3 roulette-bonus.invalid/de m.pokerwin.invalid/fr big-jackpot.invalid/spin vegas-slots-online.invalid/es/4 bingo-bonus.invalid"),
    (1, "payday-loans.invalid/apply www.quick-loan.invalid/en fast-cash-loans.invalid/de crypto-double.invalid/en/1 double-your-coins.invalid get-rich-quick.invalid/fr easy-cash.invalid/now"),
    (1, "verify-account.invalid/login secure-login-update.invalid/en www.account-verify.invalid/de password-reset-now.invalid login-confirm.invalid/fr/2 free-crack-download.invalid keygen-crack.invalid/dl serial-keygen.invalid/en"),
    (1, "replica-watches.invalid/en www.fake-handbags.invalid/de/2 hookup-dating.invalid/chat sexy-singles.invalid/en m.hot-singles.invalid/fr porn-tube.invalid/v/7 www.xxx-tube.invalid/de nude-cams.invalid/en"),
    (0, "bakery.invalid/en www.bicycle-club.invalid/de/7 gardening-tips.invalid/es m.chess.invalid/fr/1 orchestra.invalid/en astronomy.invalid/de www.painting-school.invalid/en/2 river-walks.invalid"),
    (0, "parliament.invalid/en/4 www.court-records.invalid city-council.invalid/de/1 tax-office.invalid/fr election-results.invalid/es post-office.invalid/en m.statistics.invalid/de/8 archive.invalid"),
    (0, "software-docs.invalid/en/api www.code-review.invalid/de open-source.invalid/fr database.invalid/en/5 compiler.invalid kernel-notes.invalid/en m.python-tips.invalid/es/3 algorithms.invalid/de"),
    (0, "marathon.invalid/en www.swimming.invalid/de/3 hockey.invalid/fr m.tennis-club.invalid/es/5 skiing.invalid opera.invalid/en/2 theatre-tickets.invalid/de poems.invalid/fr/8 novel-reviews.invalid/en"),
]


#: Neutral surroundings, so that a label is learnt from the name and not from where it stands.
BEFORE, BEHIND = ("", "www.", "m.", "blog."), ("com", "net", "org")


def labelled() -> list[tuple[str, int]]:
    """Every URL of the table as it stands, and with its name as a subdomain of a reserved domain."""
    found = []
    for k, (y, url) in enumerate((y, url) for y, urls in LABELLED for url in urls.split()):
        host, slash, path = url.partition("/")
        name = host.removeprefix("www.").removeprefix("m.").removeprefix("blog.").rpartition(".")[0]
        found += [(f"https://{url}", y), (f"https://{BEFORE[k % 4]}{name}.example.{BEHIND[k % 3]}{slash}{path}", y)]
    return found


def host_of(url: Column) -> Column:
    """What follows the first ``://``, up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, slash, rest = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + rest)
        found = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def grams(host: str, path: str, bits: int) -> np.ndarray:
    """Distinct buckets of the character 3- to 5-grams of host (marked ends) and path (digits as 0)."""
    shape = "".join("0" if c.isdecimal() else c for c in path)
    found = {zlib.crc32(f"{kind}{text[i : i + n]}".encode("utf-8", "surrogatepass")) % (1 << bits) for kind, text in (("h", f"^{host}$"), ("p", f"{shape}$")) for n in (3, 4, 5) for i in range(len(text) - n + 1)}
    return np.fromiter(found, dtype=np.int64, count=len(found))


def parts(url: str | None) -> tuple[str, str]:
    """host_of and path_of for one URL of the labelled table."""
    rest = (url or "").partition("://")[2]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail.partition("#")[0].partition("?")[0]


def train(table: list[tuple[str, int]], *, bits: int = 18, prior: float = 0.2, steps: int = 600, rate: float = 0.5, l2: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic regression, by plain gradient descent from zero (no randomness). The bias is the log-odds of ``prior``, the share of blocked URLs to expect where n-grams say nothing."""
    rows = [grams(*parts(url), bits) for url, _ in table]
    y = np.array([label for _, label in table], dtype=float)
    w, b = np.zeros(1 << bits), math.log(prior / (1 - prior))
    scale = [1 / math.sqrt(max(1, len(r))) for r in rows]
    for _ in range(steps):
        g = l2 * w
        for r, s, label in zip(rows, scale, y):
            e = 1 / (1 + math.exp(-max(-30.0, min(30.0, s * w[r].sum() + b)))) - label
            g[r] += e * s / len(rows)
        w = w - rate * len(rows) / 10 * g
    return w, b


def judge(pages: DataFrame, *, url_col: str = "url", rules=RULES, table: list[tuple[str, int]] | None = None, threshold: float = 0.5, bits: int = 18) -> DataFrame:
    """``pages`` with host, path, rule, score (the model's probability of block) and verdict.

    A null URL, or one without ``://``, has an empty host and path and no rule;
    its score is the model's for no n-grams. Rows are judged one by one, so
    ties and repeated rows need no care; input columns with the names of the
    added ones are replaced; an empty table gives an empty one.
    """
    weights, bias = train(labelled() if table is None else table, bits=bits)

    @F.pandas_udf("double")
    def score(host: pd.Series, path: pd.Series) -> pd.Series:
        @lru_cache(maxsize=50_000)
        def one(h: str, p: str) -> float:
            r = grams(h, p, bits)
            z = weights[r].sum() / math.sqrt(len(r)) + bias if len(r) else bias
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

        return pd.Series([one(h, p) for h, p in zip(host, path)], dtype=float)

    parts = packed(pages).select("row", host_of(of_row(url_col)).alias("host"), path_of(of_row(url_col)).alias("path"))
    out = parts.withColumns({"score": score("host", "path"), "fit": matched_rule(F.col("host"), F.col("path"), list(rules))})
    verdict = F.coalesce("fit.verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return unpacked(out, pages.columns, {"host": F.col("host"), "path": F.col("path"), "score": F.col("score"), "rule": F.col("fit.rule"), "verdict": verdict})
