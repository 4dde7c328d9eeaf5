"""Operator 6: URL filter, a logistic regression on hashed character n-grams of host and path.

The model is trained in numpy on the driver from a small labelled URL table (about a hundred rows) and has integer
weights, so that scoring is exact arithmetic in any engine. Scoring is built-in expressions over one url: a map over
the scan that reads the url column alone.

Defined results
* null url, or one without '://': host and path empty, no rule fits, the model sees empty strings and allows;
* of rules that fit, the longest wins, and of equally long ones the first of the table;
* very long urls are scored whole, by the mean over their n-grams; a logit of exactly 0 allows;
* rows without a page_id keep their null id; repeated rows give repeated results; extra columns are ignored; an empty
  table gives an empty result.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let

SIZES = (3, 4, 5)
BUCKETS = 4096
BASE = 131
SCALE = 1_000_000


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the contract.
RULES = (
    UrlRule("net", "/", "block"),
    UrlRule("example.net", "/en/", "allow"),
    UrlRule("example.com", "/de/", "block"),
    UrlRule("org", "/fr/", "allow"),
)

#: The labelled URL table, made up for this purpose: hosts and paths of unwanted sites (1) and of ordinary ones (0).
BAD = """casino-wins.example.com/en/1 online-casino.example.org/slots bets-free.example.com/de/77 best-bets.example.org/odds
bet-bonus.example.net/win pills-cheap.example.com/fr/12 pills-online.example.org/buy cheap-meds.example.net/order
ads-tracks.example.com/en/5 ad-tracker.example.org/pixel track-ads.example.net/click clicks-ads.example.com/banner
win-cash.example.org/prize free-casino.example.net/spins poker-win.example.com/table slots-free.example.org/play
viagra-shop.example.com/cheap payday-loan.example.org/apply quick-loans.example.net/cash xxx-cams.example.com/live
adult-porn.example.org/video x-adult.example.com/en/6 adult-chat.example.net/x hot-sex.example.net/chat replica-watch.example.com/sale fake-rolex.example.org/buy
win-prize.example.com/claim lottery-win.example.net/jackpot free-iphone.example.org/claim crypto-double.example.com/win
casino.example.org/bonus bets.example.net/free pills.example.com/cheap warez-crack.example.org/keygen
torrent-free.example.net/movie cheap-seo.example.com/links buy-followers.example.org/likes spam-mail.example.net/list link-farm.example.com/en/3
sports-bets.example.com/tips casino-bonus.example.net/de/9 cheap-viagra.example.org/en/3 ads-click.example.com/fr/8""".split()
GOOD = """theword.example.com/fr/82 nations.example.net/en/7817 herald.example.org/en/8423 thankful.example.com/en/7944
blog.motion.example.com/fr/7424.html thirsty.example.net/fr/4163 www.gathering.example.org/en/1291/ news.example.org/world
docs.example.com/guide/start library.example.org/books/12 university.example.net/research weather.example.com/today
recipes.example.org/bread gardening.example.net/roses museum.example.com/visit www.city.example.org/council
history.example.net/rome physics.example.com/waves m.theory.example.net/de/5989 blog.travel.example.org/alps
forum.example.com/topic/9 wiki.example.org/page/Tree shop.example.net/shoes/4 school.example.com/class/2
health.example.org/advice bank.example.net/branches trains.example.com/timetable films.example.org/review
music.example.net/jazz code.example.com/python m.thehouse.example.org/en/4 www.thousand.example.com/es/3102
statistics.example.org/census language.example.net/grammar water.example.com/rivers energy.example.org/solar
kitchen.example.net/soup astronomy.example.com/mars www.post.example.org/letters blog.northern.example.org/en/14355/
tenth.example.net/es/8924 others.example.org/en/5397.html therapy.example.org/fr/7855.html m.mathes.example.org/en/873
blog.fashion.example.com/en/4903/ worth.example.org/en/270 stable.example.org/en/482/ thatch.example.net/de/41
about.example.com/team contact.example.org/us press.example.net/release events.example.com/2020/05 art.example.org/gallery
thinner.example.net/es/2547/ edition.example.com/reader inger.example.org/de/88 onthe.example.net/en/6 erand.example.com/4
further.example.com/en/612?page=2 blog.threads.example.net/de/61.html m.weather.example.org/es/9 www.bathed.example.com/en/77/""".split()


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, label) of the table; label 1 is unwanted."""
    rows = [(u, 1) for u in BAD] + [(u, 0) for u in GOOD]
    return [(u.partition("/")[0], "/" + u.partition("/")[2], y) for u, y in rows]


def ngram_counts(text: str, salt: int) -> tuple[np.ndarray, int]:
    """Counts of hashed n-grams of '^text$' in the buckets, and their number. salt: 0 for hosts, 1 for paths."""
    codes = np.array([ord(c) % 256 for c in f"^{text}$"], np.int64)
    out, n = np.zeros(BUCKETS), 0
    for size in SIZES:
        m = len(codes) - size + 1
        if m <= 0:
            continue
        h = np.full(m, salt, np.int64)
        for k in range(size):
            h = h * BASE + codes[k : k + m]
        np.add.at(out, h % BUCKETS, 1)
        n += m
    return out, n


@dataclass(frozen=True)
class Model:
    """Integer weights (SCALE is 1.0) for mean n-gram counts of host and path, and the bias."""

    weights: tuple[int, ...]
    bias: int


@functools.lru_cache(1)
def train(steps: int = 400, rate: float = 200.0, decay: float = 2e-5) -> Model:
    """Batch gradient descent on the logistic loss, always the same result."""
    rows, y = [], []
    for host, path, label in labelled_urls():
        a, n = ngram_counts(host, 0)
        b, m = ngram_counts(path, 1)
        rows.append(a / max(n, 1) + 0.3 * b / max(m, 1))
        y.append(label)
    x, t = np.array(rows), np.array(y, float)
    share = np.where(t == 1, 0.5 / t.sum(), 0.5 / (1 - t).sum())
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(steps):
        g = share * (1 / (1 + np.exp(-(x @ w + b))) - t)
        w -= rate * (x.T @ g + decay * w)
        b -= 0.5 * g.sum()
    return Model(tuple(int(v) for v in np.rint(w * SCALE)), int(np.rint(b * SCALE)))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(_after(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1)


def _after(url: Column) -> Column:
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, F.lit("://"))
    return F.when(at > 0, F.substr(whole, at + 3)).otherwise(F.lit(""))


def _sum(text: Column, salt: int, model: Model) -> Column:
    """(sum of weights, number of n-grams) of one string."""
    # one string literal, folded to an array at planning: a literal for each weight would take as many calls
    weights = F.split(F.lit(",".join(map(str, model.weights))), ",").cast("array<bigint>")

    def summed(codes: Column) -> Column:
        n = F.size(codes)
        total, count = F.lit(0).cast("long"), F.lit(0)
        for size in SIZES:
            def bucket(i: Column, size: int = size) -> Column:
                h = F.lit(salt).cast("long")
                for k in range(size):
                    h = h * BASE + F.get(codes, i + k)
                return F.get(weights, (h % BUCKETS).cast("int"))

            # with fewer characters than size + 1 there is no second window and maybe no first one
            starts = F.when(n >= size, F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))).otherwise(F.array().cast("array<int>"))
            total = total + F.aggregate(starts, F.lit(0).cast("long"), lambda a, i: a + bucket(i))
            count = count + F.greatest(n - size + 1, F.lit(0))
        return F.struct(total.alias("total"), count.cast("long").alias("n"))

    marked = F.concat(F.lit("^"), text, F.lit("$"))
    # parted once: a substring of each place would be searched for from the start
    codes = F.transform(F.split(marked, ""), lambda c: (F.ascii(c) % 256).cast("long"))
    return let(codes, summed)


def judge(df: DataFrame, url: str = "url", rules: tuple[UrlRule, ...] = RULES, model: Model | None = None) -> DataFrame:
    """df with host, path, rule (null: none fits), logit of the model, verdict; columns of these names are replaced."""
    model = model or train()
    out = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    fits = [
        F.when(((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path)), F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict")))
        for r in sorted(rules, key=lambda r: -len(r.name))
    ]
    out = out.withColumns({"_rule": F.coalesce(*fits), "_host": _sum(F.col("host"), 0, model), "_path": _sum(F.col("path"), 1, model)})
    out = out.withColumn(
        "logit",
        (F.col("_host.total") / F.greatest(F.col("_host.n"), F.lit(1)) + F.lit(0.3) * (F.col("_path.total") / F.greatest(F.col("_path.n"), F.lit(1))) + F.lit(float(model.bias))) / F.lit(float(SCALE)),
    )
    return out.withColumns(
        {"rule": F.col("_rule.name"), "verdict": F.coalesce(F.col("_rule.verdict"), F.when((F.col("host") != "") & (F.col("logit") > 0), "block").otherwise("allow"))}
    ).drop("_rule", "_host", "_path")


def op6_url_filters(df: DataFrame) -> DataFrame:
    """The contract's digest: one row for each page."""
    return judge(df.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """DuckDB SQL for `op6_url_filters`, with the trained weights as a list."""
    model = train()
    fits = " ".join(
        f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{r.name}={r.verdict}'"
        for r in sorted(RULES, key=lambda r: -len(r.name))
    )

    def mean(codes: str, salt: int) -> str:
        sums = []
        for size in SIZES:
            h = str(salt)
            for k in range(size):
                h = f"({h} * {BASE} + {codes}[i + {k}])"
            sums.append(f"coalesce(list_sum(list_transform(range(1, len({codes}) - {size - 2}), lambda i: w[{h} % {BUCKETS} + 1])), 0)")
        n = " + ".join(f"greatest(len({codes}) - {size - 1}, 0)" for size in SIZES)
        return f"(cast({' + '.join(sums)} as bigint) / greatest({n}, 1))"

    return rf"""
with w as (select [{", ".join(map(str, model.weights))}]::bigint[] as w),
a as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages),
b as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
             regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from a),
c as (select *, list_transform(string_split('^' || host || '$', ''), lambda x: unicode(x)::bigint % 256) as hc,
             list_transform(string_split('^' || path || '$', ''), lambda x: unicode(x)::bigint % 256) as pc,
             case {fits} end as fit from b),
d as (select *, ({mean("hc", 0)} + 0.3::double * {mean("pc", 1)} + {float(model.bias)}::double) / {float(SCALE)}::double as logit from c, w)
select page_id, host, path, split_part(fit, '=', 1) as rule,
       coalesce(split_part(fit, '=', 2), case when host <> '' and logit > 0 then 'block' else 'allow' end) as verdict from d
"""
