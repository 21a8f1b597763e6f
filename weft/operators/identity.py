"""Near-duplicate entities: candidates by MinHash bands, guarded verification, merging, edge rewriting."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from weft.functions.similarity import band_keys, jaro_winkler_of, plain_label
from weft.functions.text import digit_runs, entropy, label_shape
from weft.operators.components import connected_components
from weft.plans.runtime import cut, ship

#: Fixed values of the rules.
LEAST_ENTROPY, LEAST_SCORE, SAME_COMMUNITY, SHORT = 2.5, 92.0, 5.0, 4
#: Nodes that are identities or evidence, and never merge.
FIXED_TYPES = ("code", "test", "stub", "package", "rationale", "document", "reference", "paper", "chunk")
PROSE_TYPES = ("document", "paper", "image", "video")


@lru_cache(maxsize=100_000)
def _parts(norm: str) -> tuple[tuple, tuple]:
    """Sorted digit runs, and sorted tokens that aren't numbers."""
    digits = "".join(c if "0" <= c <= "9" else " " for c in norm).split()
    words = [w for w in norm.split(" ") if w and not all("0" <= c <= "9" for c in w)]
    return tuple(sorted(digits)), tuple(sorted(words))


def mergeable(a: dict, b: dict) -> bool:
    """Whether two entities (norm, file_type, source_file, community, shape) are one by score and guards."""
    x, y = a["norm"], b["norm"]
    score = 100 * jaro_winkler_of(x, y)
    if a["community"] is not None and a["community"] == b["community"]:
        score += SAME_COMMUNITY
    if score < LEAST_SCORE or a["shape"] != b["shape"]:
        return False
    (dx, wx), (dy, wy) = _parts(x), _parts(y)
    if dx != dy or (wx == wy and x != y):
        return False
    small, large = sorted((wx, wy), key=len)
    if small and len(small) < len(large) and set(small) <= set(large):
        return False
    if min(len(x), len(y)) <= SHORT and (len(x) != len(y) or sum(p != q for p, q in zip(x, y)) > 1):
        return False
    return not (a["file_type"] in PROSE_TYPES and b["file_type"] in PROSE_TYPES and a["source_file"] != b["source_file"])


def merge_map(nodes: DataFrame) -> DataFrame:
    """(id, survivor) of the nodes that merge into another: that of the group's shortest label, then of the smallest id.

    Equal entities are one before bands are compared. In a band's bucket pairs are verified in memory;
    those in one group already aren't compared, and only a spanning forest leaves the bucket.
    """
    ship(nodes.sparkSession)

    @F.pandas_udf("string")
    def plain(labels: pd.Series) -> pd.Series:
        return labels.map(lambda s: None if s is None else plain_label(s))

    named = nodes.filter(~F.col("file_type").isin(*FIXED_TYPES) & (F.coalesce("label", F.lit("")) != ""))
    named = named.withColumn("shape", label_shape(F.col("label"))).filter("shape <> 'file'").withColumn("norm", plain(F.col("label")))
    named = cut(named.filter((F.col("norm") != "") & (entropy(F.col("norm")) >= LEAST_ENTROPY)).select("id", "label", "norm", "file_type", "source_file", "community", "shape"))
    keys = ["norm", "file_type", "source_file", "community", "shape"]
    alike = named.groupBy(*keys).agg(F.min("id").alias("lead"))
    same = named.join(alike, [named[k].eqNullSafe(alike[k]) for k in keys]).filter("id <> lead").select(F.col("id").alias("src"), F.col("lead").alias("dst"))
    bands = F.transform(band_keys(F.col("norm")), lambda k, i: F.struct(i.alias("band"), k.alias("hash")))
    # Entities of other digit runs or shapes never merge, so they needn't meet, and who is alone with its own needs no bands.
    home = F.xxhash64(F.array_join(digit_runs(F.col("norm")), " "), "shape")
    housed = alike.withColumn("home", home).withColumn("n", F.count("*").over(Window.partitionBy("home"))).filter("n > 1").drop("n")
    banded = housed.withColumn("bands", bands).withColumn("key", F.explode("bands"))
    banded = banded.withColumn("key", F.xxhash64("key.band", "key.hash", "home")).drop("home")
    crowded = banded.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    met = banded.drop("bands").join(crowded, "key", "left_semi")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = frame["key"].iloc[-1] if len(frame) else None
            rest = frame[frame["key"] == last]
            yield links(frame[frame["key"] != last])
        if rest is not None:
            yield links(rest)

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in frame.groupby("key", sort=False):
            rows = [{k: None if v is None or v != v else v for k, v in r.items()} for r in group.to_dict("records")]
            clusters: list[list[dict]] = []
            for row in rows:
                joined = [c for c in clusters if any(mergeable(row, other) for other in c)]
                out += [(row["lead"], c[0]["lead"]) for c in joined]
                merged = [row, *(x for c in joined for x in c)]
                clusters = [c for c in clusters if c not in joined] + [merged]
        return pd.DataFrame(out, columns=["src", "dst"])

    found = met.repartition("key").sortWithinPartitions("key").mapInPandas(verify, "src string, dst string")
    groups = cut(connected_components(found.unionByName(same)))
    sized = named.join(groups, named["id"] == groups["node"]).withColumn("n", F.octet_length("label"))
    best = sized.groupBy("component").agg(F.min(F.struct("n", "id"))["id"].alias("survivor"))
    return sized.join(best, "component").filter("id <> survivor").select("id", "survivor")


def apply_merges(nodes: DataFrame, edges: DataFrame, merges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph with edges moved to survivors, without the merged nodes and without the loops that this makes."""
    renamed = edges
    for side in ("source", "target"):
        names = merges.select(F.col("id").alias("old"), F.col("survivor").alias("new"))
        renamed = renamed.join(names, F.col(side) == F.col("old"), "left").withColumn(side, F.coalesce("new", side)).drop("old", "new")
    return nodes.join(merges, "id", "left_anti"), renamed.filter("source <> target").select(*edges.columns)
