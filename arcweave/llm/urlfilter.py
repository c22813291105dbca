"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

Host and path are read off by SQL expressions, and so is the longest rule that
fits.  The regression is trained from a small labelled URL table (a few dozen
words make it) and scored over Arrow batches as one sparse sum per URL; its
weights have a fixed size.  One pass over the url column alone, no shuffle.

Null url or one without `://`: empty host and path, no rule, judged by the
method like any other.  Repeated rows get equal verdicts; empty table: no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import arrays, map_arrow

#: Words of hosts and paths to block, and ordinary ones.
BAD_WORDS = ("adult", "adult-x", "porn", "xxx", "sex", "casino", "poker", "betting", "slots", "pills", "viagra", "warez", "torrent-free", "crack", "malware", "phish", "spam", "spamfarm", "cheap-loans", "escort", "nude", "freemoney", "clickbait", "win-prize", "hack", "bets", "cheap", "ads", "track", "tracker", "banner", "doubleclick", "popunder", "jackpot", "gamble", "hentai", "farm-links", "replica")
GOOD_WORDS = ("news", "blog", "wiki", "docs", "science", "garden", "travel", "library", "school", "city", "recipes", "music", "forum", "shop", "weather", "sports", "museum", "history", "essex", "middlesex", "sussex", "analysis", "expert", "therapist", "spokane", "pillow", "bethel", "crackers", "hackney", "document", "better", "adsorb", "adobe", "trackside", "winter", "window", "free", "farm", "link", "cheaper-by-the-dozen", "roadside", "gadgets", "beads", "running-track")
SUFFIXES = ("example.com", "example.net", "example.org", "com", "org", "net")
PATHS = ("/", "/en/12", "/de/345", "/fr/67.html", "/es/89/", "/index.html", "/a/b", "")
SYLLABLES = ("th", "er", "on", "in", "an", "re", "nd", "ti", "sh", "ed", "ble", "tion", "ing", "ha", "he", "st", "es", "or", "it", "al")
BITS = 14


def made_up(i: int) -> str:
    """A plain host name of short syllables."""
    return "".join(SYLLABLES[(i * 7 + k * k * 3 + i // 20 * (k + 1)) % 20] for k in range(2 + i % 3))


def labelled() -> list[tuple[str, str, int]]:
    """The training table: (host, path, 1 to block).  Each URL to block has a twin to allow, which differs in the telling word only; some plain hosts follow."""
    out = []
    for i, bad in enumerate(BAD_WORDS):
        for j, s in enumerate(SUFFIXES):
            path, front = PATHS[(i + j) % len(PATHS)], ("", "www.", "m.", "blog.")[(i + j) % 4]
            good, plain = GOOD_WORDS[(i + j) % len(GOOD_WORDS)], made_up(i * len(SUFFIXES) + j)
            other, second = BAD_WORDS[(i * 5 + j + 1) % len(BAD_WORDS)], made_up(i * 11 + j)
            out += [(f"{front}{bad}.{s}", path, 1), (f"{front}{plain}.{s}", path, 0)]
            out += [(f"{front}{bad}-{other}.{s}", path, 1), (f"{front}{good}-{second}.{s}", path, 0)]
            out += [(f"{front}{plain}.{s}", f"/{bad}{path}", 1), (f"{front}{plain}.{s}", f"/{good}{path}", 0)]
            out += [(f"{f}{made_up(i * 17 + j * 3 + k)}.{s}", path, 0) for k, f in enumerate(("", "www.", "m.", "blog."))]
            out += [(f"{front}{bad}{i}.{s}", path, 1), (f"{front}{good}{i}.{s}", path, 0)]
    return out


def grams(host: str, path: str, low: int = 3, high: int = 5) -> np.ndarray:
    """Hashed n-grams of `<host>` and of the path, each part apart."""
    found = []
    for tag, text in (("h", f"<{host}>"), ("p", f"{path}>")):
        for n in range(low, high + 1):
            found += [zlib.crc32(f"{tag}{text[i : i + n]}".encode("utf-8", "replace")) & ((1 << BITS) - 1) for i in range(len(text) - n + 1)]
    return np.unique(np.array(found, np.int64))


def train(table: list[tuple[str, str, int]] | None = None, steps: int = 800, l2: float = 1e-5) -> np.ndarray:
    """Weights, the last one the intercept, by full-batch gradient steps with momentum."""
    table = table if table is not None else labelled()
    rows = [grams(h, p) for h, p, _ in table]
    y = np.array([b for *_, b in table], float)
    at, of = np.concatenate([*rows, np.zeros(0, np.int64)]), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    value = np.repeat([1 / np.sqrt(max(1, len(r))) for r in rows], [len(r) for r in rows])
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))  # both classes count alike
    w, speed = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for _ in range(steps if len(rows) else 0):
        d = weight * (1 / (1 + np.exp(-(np.bincount(of, value * w[at], len(rows)) + w[-1]))) - y)
        speed = 0.9 * speed - 2.0 * (np.append(np.bincount(at, value * d[of], 1 << BITS), d.sum()) + l2 * np.append(w[:-1], 0))
        w += speed
    return w


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def rule_columns(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule's text and verdict (null: none fits).  rules: (verdict, host, path); of equal length, the longer host wins."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], threshold: float = 0.5, weights: np.ndarray | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and the regression's probability of every row."""
    weights = train() if weights is None else weights
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("score", pa.float64())])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hosts, paths, by_rule = (batch.column(i).to_pylist() for i in (1, 2, 4))
        rows = [grams(h, p) for h, p in zip(hosts, paths, strict=True)]
        z = np.array([weights[r].sum() / np.sqrt(max(1, len(r))) for r in rows]) + weights[-1]
        score = np.where([len(r) > 0 for r in rows], 1 / (1 + np.exp(-z)), 0.0)  # nothing to go by: allowed
        return arrays(schema, batch.column(0), batch.column(1), batch.column(2), batch.column(3), [v or ("block" if s >= threshold else "allow") for v, s in zip(by_rule, score.tolist(), strict=True)], score)

    host, path = parts(F.col(url_col))
    split = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return map_arrow(split.select("page_id", "host", "path", name.alias("rule"), verdict.alias("verdict")), run, "page_id long, host string, path string, rule string, verdict string, score double")
