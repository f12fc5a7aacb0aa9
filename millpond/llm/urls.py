"""URL filters: host and path rules, and a logistic regression on character n-grams for what no rule decides.

The rules and the labelled table are small parameters; every URL is judged by itself, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 16
SIZES = (3, 4, 5)
LABELLED_ROWS = 10_000  # a larger labelled table is refused: it is fitted on the driver
# The rules, as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
# Site names of the small labelled URL table.
BLOCKED = """
spam-farm spam-site link-farm seo-links best-casino casino-bonus casino-win online-slots poker-room bet-now free-bets sports-betting cheap-pills
pharma-deals buy-viagra diet-pills replica-watches xxx-videos hot-porn adult-cams free-sex escort-girls payday-loans quick-cash get-rich
crypto-doubler free-bitcoin warez-crack torrent-hub keygen-zone hacked-accounts malware-drop phishing-login ads-track click-ads popup-ads
adserver win-prizes
""".split()
ALLOWED = """
library museum news garden weather docs history university school recipes travel sports city-hall health hospital science math music theatre books
linux developer maps trains nature tea chess letters others the-times gardening thread hearth tower station northern another mother gathering
tenth width thousand thirteen thunder method birth path athens theory ethics earth
""".split()


def labelled_urls() -> list[tuple[str, int]]:
    """(host and path, 1 to block): each name under each ending, with prefixes and paths that say nothing in turn."""
    prefixes, paths = ("", "www.", "m.", "blog."), ("/en/853/", "/fr/90.html", "/es/533", "/de/17/", "/")
    out = []
    for label, names in ((1, BLOCKED), (0, ALLOWED)):
        for i, name in enumerate(names):
            for j, end in enumerate(("com", "net", "org")):
                out.append((f"{prefixes[(i + j) % 4]}{name}.example.{end}{paths[(i + 2 * j) % 5]}", label))
    return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z in lower case; empty where there is none."""
    at = F.instr(url, "://")
    host = F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"(?s)\A[^/?#]*", 0)
    return F.when(at > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"(?s)\A[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]], verdict: bool = False) -> Column:
    """The longest rule, as written, that fits the host or one it is a subdomain of and the start of the path."""
    out = F.lit(None).cast("string")
    for kind, at, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(start))
        out = F.when(fits, F.lit(kind if verdict else at + start)).otherwise(out)
    return out


def fit(labelled: list[tuple[str, int]], bits: int = BITS, sizes: tuple[int, ...] = SIZES):
    """Weights and intercept from (host and path, 1 to block) pairs, at most ``LABELLED_ROWS`` of them."""
    import numpy as np

    from millpond.llm.ngrams import Distinct, logistic

    if len(labelled) > LABELLED_ROWS:
        raise ValueError(f"more than {LABELLED_ROWS} labelled rows")
    distinct = Distinct(sizes, bits)
    rows = [distinct(f"^{text}$") for text, _ in labelled]
    return logistic(rows, np.array([y for _, y in labelled], float), np.ones(1 << bits), 1e-3)


def judge(pages: DataFrame, rules=RULES, labelled: list[tuple[str, int]] | None = None, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score (null where a rule decides) of every row.

    A null URL or one without ``://`` has an empty host and path, fits no rule and is scored as empty, which the
    balanced fit leaves below the threshold. Rows that repeat are judged alike; other columns are left out.
    """
    import numpy as np

    model = fit(labelled_urls() if labelled is None else labelled)
    shared = pages.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # 2^BITS floats
    schema = T.StructType.fromDDL("page_id long, host string, path string, rule string, fixed string, score double")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from millpond.llm.ngrams import Distinct

        weights, bias = shared.value
        distinct = Distinct(SIZES, BITS)
        for batch in batches:
            host, path, rule = (batch.column(c).to_pylist() for c in ("host", "path", "rule"))
            z = [None if r else float(weights[distinct(f"^{h}{p}$")].sum() + bias) if h or p else float(min(bias, 0)) for h, p, r in zip(host, path, rule)]
            score = [None if x is None else float(1 / (1 + np.exp(-x))) for x in z]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule", "fixed")), pa.array(score, pa.float64())], names=schema.names)

    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    split = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    ruled = split.select("page_id", "host", "path", rule_of(host, path, rules).alias("rule"), rule_of(host, path, rules, True).alias("fixed"))
    scored = ruled.mapInArrow(run, schema)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("fixed", F.when(F.col("score") > threshold, "block").otherwise("allow")).alias("verdict"), "score")
