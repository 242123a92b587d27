"""URL filters (operator 1): host and path rules, and logistic regression where no rule fits.

Rules are host/path prefixes (``example.com/en/``); a rule fits its host and all its subdomains, the
longest one wins.  URLs that no rule decides are judged by a logistic regression on hashed character
n-grams of host and path, trained in numpy on a small labelled URL table.  Everything is a map over
rows; rules (at most ``MOST_RULES``) and weights (``2 ** BITS`` numbers) are all that is sent out.

Defined cases: a null url, or one without ``://``, has empty host and path; it is judged by the method
(no n-grams: the bias alone).  An empty labelled table, or one with one label only, judges every url
by that label, ``allow`` where there is none.  Other columns pass through ``judge`` untouched; results
take a free name where the input has one of theirs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import appended, frugal, pieces, row_sums, utf8
from .common import free_name, read_table

ALLOW, BLOCK = "allow", "block"
#: The rules that op1 applies.
RULES = {"com/": ALLOW, "example.com/en/": BLOCK, "www.example.com/en/": ALLOW, "net/es/": BLOCK, "net/fr/": BLOCK}
MOST_RULES = 1000
#: The labelled URL table that op1 trains on: stems of hosts, written by hand.  Each stem becomes a few
#: URLs (``labelled_urls``) whose prefixes, endings and paths are dealt to both labels alike.
BLOCKED_HOSTS = """
vegas-casino casino-spins casino-bonus online-casino royal-casino mega-casino slot-casino slots-win jackpot-slots jackpot-win win-big poker-bonus poker-win
best-bets bets-online sport-bets betting-tips bet-now lotto-win lottery-prize free-prize free-gift free-iphone free-money fast-money easy-money
pills-online diet-pills buy-pills pharma-cheap cheap-meds viagra-shop buy-viagra weight-loss-fast miracle-cure payday-loans fast-loans cheap-loans
loans-now quick-credit crypto-profit crypto-double bitcoin-profit get-rich rich-quick replica-watch cheap-watches cheap-bags fake-bags outlet-cheap
track-ads ad-click click-ads adserver-x ads-network popup-ads pixel-track tracker-x spam-blog link-spam bonus-bets ad-tracker tracking-ads discount-pills link-farm seo-farm backlink-farm content-farm
seo-links buy-links paid-links cheap-traffic buy-traffic fake-likes adult-films adult-chat adult-cams x-cams live-cams sexy-chat xxx-video xxx-tube porn-x hot-girls hot-dates
sexy-dates torrent-free warez-x crack-keys serial-keys keygen-x free-movies-x phish-login login-verify account-verify
"""
ALLOWED_HOSTS = """
daily-news city-news local-news morning-post evening-times the-gazette weather-report science-journal nature-notes history-museum art-museum city-library
state-university college-courses primary-school research-lab physics-group math-notes open-data docs manual wiki-pages handbook reference-guide
garden-tips home-cooking family-recipes bread-baker book-club film-review music-theory jazz-archive chess-club cycling-tour running-club mountain-trails
travel-notes train-times bus-routes city-hall tax-office health-clinic hospital-info doctor-advice pharmacy-guide law-review court-records parliament
software-blog code-review python-notes database-forum linux-users hardware-test photo-diary bird-watch astronomy-now geology-maps ocean-science
farm-museum loan-law ad-history track-athletics theatre-hall sports-news football-results bank-history insurance-guide energy-watch climate-facts
language-school dictionary grammar-help poetry-corner writers-circle teachers-room parents-forum child-care village-church charity-work
oldmill riverside northgate thornton wetherby hathersage ashington easterly ingleton anderson brennan tonbridge arlington shelton
lamontre eaubonne laurier quelier monterre parisien valdoise aimont entier rouviere
schonau einheim ungerer chemnitz verlag lichten derwald heitmann pfarrer kuchen
"""
BITS, ORDERS, STEPS, RATE, SHRINK = 18, (2, 3, 4, 5), 150, 0.5, 1e-6
#: Labelled URLs that a model is trained on: about so many, drawn by a hash of the url.
LABELLED = 4000
_BEFORE, _AFTER = ("", "www.", "m.", "blog."), (".example.com", ".example.net", ".example.org")
_PATHS = ("/", "/en/4711", "/fr/82.html", "/de/1093/", "/es/66021", "/index.html", "/en/news/12", "/about")


def host_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, else null."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    found = []
    for rule in sorted(rules, key=lambda r: (-len(r), r)):
        on, slash, below = rule.partition("/")
        fits = ((host == on) | host.endswith("." + on)) & path.startswith(slash + below)
        found.append(F.when(fits, F.lit(rule)))
    return F.coalesce(*found, F.lit(None).cast("string")) if found else F.lit(None).cast("string")


def _grams(data: np.ndarray, bounds: np.ndarray, field: int):
    """Hashed n-grams of one field, with a mark at both ends, and their bounds by row."""
    n = len(bounds) - 1
    padded = np.full(len(data) + 2 * n, 1, np.uint64)
    at = bounds + 2 * np.arange(n + 1)
    inside = np.ones(len(padded), bool)
    inside[at[:-1]] = False
    inside[at[1:] - 1] = False
    padded[inside] = data
    for order in ORDERS:
        length = max(len(padded) - order + 1, 0)
        code = np.zeros(length, np.uint64)
        for k in range(order):
            code = code * np.uint64(257) + padded[k : k + length]
        ids = ((code + np.uint64(order * 2 + field)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        row = np.repeat(np.arange(n), np.diff(at))[:length]
        last = at[1:][row]
        whole = np.arange(length) + order <= last
        yield ids[whole].astype(np.int64), row[whole]


def grams(hosts: pa.Array, paths: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All n-gram ids of the rows, sorted by row, and the bounds of each row."""
    found = [x for field, column in enumerate((hosts, paths)) for x in _grams(*utf8(column), field)]
    ids, rows = np.concatenate([i for i, _ in found]), np.concatenate([r for _, r in found])
    order = np.argsort(rows, kind="stable")
    return ids[order], np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(hosts)))])


@dataclass
class Model:
    """``weights`` over hashed n-grams; the probability is that of ``block``."""

    weights: np.ndarray
    bias: float

    def score(self, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
        ids, bounds = grams(hosts, paths)
        scale = 1 / np.sqrt(np.maximum(np.diff(bounds), 1))
        return 1 / (1 + np.exp(-(row_sums(self.weights[ids], bounds) * scale + self.bias)))


def train(hosts: pa.Array, paths: pa.Array, blocked: np.ndarray) -> Model:
    """Full-batch logistic regression with AdaGrad steps and L2 shrinkage."""
    y = np.asarray(blocked, float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS), 20.0 if len(y) and y[0] else -20.0)
    ids, bounds = grams(hosts, paths)
    scale = 1 / np.sqrt(np.maximum(np.diff(bounds), 1))
    row = np.repeat(np.arange(len(y)), np.diff(bounds))
    used, ids = np.unique(ids, return_inverse=True)
    w, b, seen, seen_b = np.zeros(len(used)), 0.0, np.full(len(used), 1e-8), 1e-8
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(row_sums(w[ids], bounds) * scale + b)))
        wrong = (p - y) / len(y)
        g = np.bincount(ids, (wrong * scale)[row], len(used)) + SHRINK * w
        seen += g * g
        seen_b += wrong.sum() ** 2
        w -= RATE * g / np.sqrt(seen)
        b -= RATE * wrong.sum() / np.sqrt(seen_b)
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return Model(weights, float(b))


def fit(labelled: DataFrame, url: str = "url", label: str = "label") -> Model:
    """A model from a labelled table: ``label`` is allow or block.  Larger tables are drawn from by a hash
    of the url, about ``LABELLED`` rows."""
    rows = labelled.where(F.col(url).isNotNull() & F.col(label).isin(ALLOW, BLOCK))
    n = rows.count()
    host, path = host_path(F.col(url))
    share = min(1.0, LABELLED / max(n, 1))
    drawn = rows.where(F.pmod(F.xxhash64(url), F.lit(1 << 30)) < int(share * (1 << 30)) if share < 1 else F.lit(True))
    # one url many times counts once; what stays is at most about LABELLED rows
    drawn = drawn.select(host.alias("h"), path.alias("p"), (F.col(label) == BLOCK).alias("b")).distinct()
    table = drawn.toArrow().sort_by([("h", "ascending"), ("p", "ascending"), ("b", "ascending")])
    return train(table.column("h"), table.column("p"), table.column("b").to_numpy(zero_copy_only=False))


def ruled(pages: DataFrame, rules: dict[str, str] = RULES, url: str = "url") -> tuple[DataFrame, dict[str, str]]:
    """``pages`` with host, path and rule, and the names these got."""
    names: dict[str, str] = {}
    for c in ("host", "path", "rule"):
        names[c] = free_name([*pages.columns, *names.values()], c)
    host, path = host_path(F.col(url))
    out = pages.withColumns({names["host"]: host, names["path"]: path})
    return out.withColumn(names["rule"], rule_of(F.col(names["host"]), F.col(names["path"]), rules)), names


def judge(pages: DataFrame, model: Model, rules: dict[str, str] = RULES, url: str = "url") -> tuple[DataFrame, dict[str, str]]:
    """``pages`` with host, path, rule, block_score (the method's, null where a rule decides) and verdict; and the names these got."""
    out, names = ruled(pages, rules, url)
    for c in ("block_score", "verdict"):
        names[c] = free_name([*out.columns, *names.values()], c)
    host, path, rule, score = (names[c] for c in ("host", "path", "rule", "block_score"))

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, path):
                open_rows = piece.column(rule).is_null()
                found = np.full(piece.num_rows, np.nan)
                at = np.flatnonzero(open_rows.to_numpy(zero_copy_only=False))
                if len(at):
                    found[at] = model.score(piece.column(host).filter(open_rows), piece.column(path).filter(open_rows))
                yield appended(piece, {score: pa.array(found, mask=np.isnan(found))})

    scored = out.mapInArrow(frugal(run), T.StructType([*out.schema.fields, T.StructField(score, T.DoubleType())]))
    decided = F.coalesce(*[F.when(F.col(rule) == r, F.lit(v)) for r, v in rules.items()]) if rules else F.lit(None)
    verdict = F.when(F.col(rule).isNotNull(), decided).otherwise(F.when(F.col(score) >= 0.5, BLOCK).otherwise(ALLOW))
    return scored.withColumn(names["verdict"], verdict), names


def labelled_urls() -> list[tuple[str, str]]:
    """The small labelled table: (url, label)."""
    out = []
    for label, stems in ((BLOCK, BLOCKED_HOSTS.split()), (ALLOW, ALLOWED_HOSTS.split())):
        for i, stem in enumerate(stems):
            for k in range(4):
                out.append((f"https://{_BEFORE[(i + k) % 4]}{stem}{_AFTER[(i + k) % 3]}{_PATHS[(i + 3 * k) % 8]}", label))
    return out


def op1(spark, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    out, _ = judge(pages, fit(spark.createDataFrame(labelled_urls(), "url string, label string")))
    return out.select("page_id", "host", "path", "rule", "verdict", "block_score")


def url_rules(spark, sf_dir: str) -> DataFrame:
    """What op1 does before the model: host, path and rule of every page."""
    out, _ = ruled(read_table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", "host", "path", "rule")


_FITS = " ".join(
    f"WHEN (host = '{on}' OR host LIKE '%.{on}') AND starts_with(path, '/{below}') THEN '{on}/{below}'" for on, below in (r.split("/", 1) for r in sorted(RULES, key=lambda r: (-len(r), r)))
)
RULES_SQL = f"""
WITH rests AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests)
SELECT page_id, host, path, CASE {_FITS} END AS rule FROM parts
"""
