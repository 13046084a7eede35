"""N-gram Jaccard join: classes of documents that are linked by word-shingle sets of high Jaccard similarity.

Method: a token-group matrix.  (1) A count-min sketch over all documents' distinct shingles tells which shingles another document may
hold; a document needs ``threshold`` of its shingles shared to have any link, so most documents are settled here: this is the bound
against the union of everything else.  (2) Documents with the same shared shingles and the same set size behave alike and become one
class.  (3) Classes with a common least fingerprint (a min-hash) form groups of bounded size.  The matrix stores, for each group, the union of its tokens; an
index of its members' prefixes (their rarest shingles, of which any link must share one) says which classes may meet which group at all.
(4) A class asks such a group's union: the tokens they have in common bound every overlap inside the group, and only groups that can still reach the
threshold qualify.  Members are sent out for qualifying groups alone; those are opened and compared member by member, exactly.
(5) Before that, each class is compared with the largest class of each of its prefix shingles; what this links needs no further
opening, which keeps groups of thousands of near copies from being compared with each other.  Links are never enumerated inside classes.

Shingles are counted as 64-bit fingerprints: two documents of a million shingles each share a false one with a chance of about 5e-8.  Classes go by 128 bits.

Defined cases: a null or blank text has no shingles and links with nothing; a text with fewer words than a shingle is one shingle; rows that repeat an
id are compared each with its own text, but classes that have the same least id count as one; a null id comes last and is its own name (null); ids may be of any type that has an order; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almagest.llm.blocks import LAST, Blocks, Sketch, WholeIds, passing, texts_of, written
from almagest.llm.hashing import COEFFICIENTS, Words, mix, whole_windows, windows

GROUP = 512
QUERIES = 2000
FEATURES = T.StructType(
    [T.StructField("ord", T.LongType()), T.StructField("n", T.LongType()), T.StructField("shared", T.LongType()), T.StructField("key_hi", T.LongType()), T.StructField("key_lo", T.LongType()), T.StructField("tokens", T.ArrayType(T.LongType()))]
)
PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts, lower-cased A-Z: fingerprints and text numbers, ascending by text."""
    words = Words(texts, lower=True)
    value = words.hashes(0)
    at = np.flatnonzero(whole_windows(words.first, words.count, size, len(value)))
    token, text = windows(value, size, 0)[at] if len(at) else value[:0], words.text_of_word()[at]
    few = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(few):  # these are one shingle each, so none repeats inside its text
        whole = np.zeros(len(few), dtype=np.uint64)
        for j in range(size - 1):
            has = words.count[few] > j
            whole[has] += COEFFICIENTS[0, j] * value[words.first[few][has] + j]
        token = np.concatenate((token, mix(whole + words.count[few].astype(np.uint64) * COEFFICIENTS[0, 4010])))
        text = np.concatenate((text, few))
    order = np.argsort(token)
    t = token[order]
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = t[1:] == t[:-1]
    some = order[same[1:] | same[:-1]]  # tokens that occur more than once in the block
    some = some[np.lexsort((text[some], token[some]))]
    t, d = token[some], text[some]
    keep = np.ones(len(order), dtype=bool)
    keep[some[1:][(t[1:] == t[:-1]) & (d[1:] == d[:-1])]] = False
    token, text = token[keep], text[keep]
    if not len(few):
        return token, text
    back = np.argsort(text, kind="stable")
    return token[back], text[back]


def least(n: str | object, percent: int) -> object:
    """SQL: fewest common shingles that a link of a set of n needs."""
    return F.ceil(F.col(n) * percent / 100)


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node reachable, for every node of the undirected edges (a, b).

    Rounds of neighbour minimum and pointer jumping over written tables; labels only fall, so an unchanged sum ends it.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("label"))
        up = step.select(F.col("node").alias("up"), F.col("label").alias("top"))
        labels = written(step.join(up, step["label"] == up["up"]).select("node", F.least("label", "top").alias("label")), "labels")


def qualifying(percent: int):
    """Which classes that ask can reach the threshold with a member, by the tokens that they have in common with the group's union?"""

    def run(asking: pd.DataFrame, union: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(union):
            tokens = np.sort(np.asarray(union["tokens"].iloc[0], dtype=np.int64))
            for cid, to, n, mine in zip(asking["cid"], asking["to"], asking["n"], asking["tokens"], strict=True):
                mine = np.asarray(mine, dtype=np.int64)
                found = tokens[np.minimum(np.searchsorted(tokens, mine), len(tokens) - 1)] == mine
                if 100 * int(found.sum()) >= percent * n:
                    out.append((cid, to))
        return pd.DataFrame(out, columns=["cid", "to"], dtype="int64")

    return run


def opened(percent: int):
    """Compares the classes that ask with one group's members; one link for each label reached."""

    def run(asking: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out: set[tuple[int, int]] = set()
        if len(members) and len(asking):
            size = members["n"].to_numpy()
            label = members["label"].to_numpy()
            lists = [np.asarray(t, dtype=np.int64) for t in members["tokens"]]
            token = np.concatenate(lists)
            owner = np.repeat(np.arange(len(lists)), [len(t) for t in lists])
            order = np.argsort(token, kind="stable")
            token, owner = token[order], owner[order]
            for n, mine, tokens in zip(asking["q_n"], asking["q_label"], asking["q_tokens"], strict=True):
                tokens = np.asarray(tokens, dtype=np.int64)
                a, z = np.searchsorted(token, tokens), np.searchsorted(token, tokens, side="right")
                count = z - a
                hits = owner[np.arange(count.sum()) + np.repeat(a - (np.cumsum(count) - count), count)]
                common = np.bincount(hits, minlength=len(lists))
                linked = (100 * common >= percent * (n + size - common)) & (label != mine)
                out.update((int(mine), int(x)) for x in np.unique(label[linked]))
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    return run


def links_between(classes: DataFrame, percent: int) -> DataFrame:
    """Enough links between classes (cid, n, members, tokens) to give their components; exact, see the module's text."""
    need = least("n", percent).cast("int")
    prefix = classes.select("cid", "n", "members", F.explode(F.slice("tokens", 1, F.greatest(F.lit(0), F.size("tokens") - need + 1))).alias("token"))
    hubs = prefix.groupBy("token").agg(F.max(F.struct("members", (-F.col("cid")).alias("least"), F.col("n").alias("hub_n"))).alias("hub"), F.count(F.lit(1)).alias("held")).filter("held > 1")
    hubs = hubs.select("token", (-F.col("hub.least")).alias("hub"), "hub.hub_n")
    star = prefix.join(hubs, "token").filter((F.col("cid") != F.col("hub")) & (F.least("n", "hub_n") * 100 >= F.greatest("n", "hub_n") * percent)).select("cid", "hub").distinct()
    of_hub = classes.select(F.col("cid").alias("hub"), F.col("n").alias("hub_n"), F.col("tokens").alias("hub_tokens"))
    compared = star.join(of_hub, "hub").join(classes.select("cid", "n", "tokens"), "cid")
    common = F.size(F.array_intersect("tokens", "hub_tokens"))
    first = compared.filter(common * 100 >= (F.col("n") + F.col("hub_n") - common) * percent).select(F.col("cid").alias("a"), F.col("hub").alias("b"))
    first = written(first, "links")

    labels = components(first)
    labelled = classes.join(labels, classes["cid"] == labels["node"], "left").select("cid", "n", "tokens", F.coalesce("label", "cid").alias("label"))
    leader = labelled.withColumn("leader", F.array_min("tokens"))  # a min-hash: similar sets mostly share it
    salt = leader.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
    grouped = leader.join(salt, "leader").select("cid", "n", "tokens", "label", F.xxhash64("leader", F.pmod(F.xxhash64("cid"), F.col("parts"))).alias("grp"))
    grouped = written(grouped, "groups")

    # A pair is found from its larger set (either, if they are equal): that asks with the prefix any link needs, the smaller is listed with the
    # shorter prefix that suffices against sets at least as large; many sets share too little to be listed at all.
    shared = F.size("tokens")
    listed = F.slice("tokens", 1, F.greatest(F.lit(0), shared - F.ceil(F.col("n") * 2 * percent / (100 + percent)).cast("int") + 1))
    asking = F.slice("tokens", 1, F.greatest(F.lit(0), shared - need + 1))
    index = grouped.select("n", "grp", "label", shared.alias("shared"), F.explode(listed).alias("token"))
    matrix = index.groupBy("token", F.col("grp").alias("to")).agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("shared").alias("most"), F.min("label").alias("x"), F.max("label").alias("y"))
    bounds = matrix.groupBy("token").agg(F.min("x").alias("x"), F.max("y").alias("y"))
    prefix = grouped.select("cid", "n", "grp", "label", shared.alias("shared"), F.explode(asking).alias("token"))
    prefix = prefix.join(bounds, "token").filter((F.col("x") != F.col("label")) | (F.col("y") != F.col("label"))).drop("x", "y")
    enough = lambda c: F.col(c) * (100 + percent) >= (F.col("n") + F.col("low")) * percent
    asks = (
        prefix.join(matrix, "token")
        .filter((F.col("low") <= F.col("n")) & (F.col("n") * percent <= F.col("high") * 100) & enough("shared") & enough("most") & ~((F.col("x") == F.col("y")) & (F.col("x") == F.col("label"))))
        .select("cid", "to")
        .distinct()
    )
    asks = written(asks, "asks")
    pairs = written(qualified(grouped, asks, percent), "qualifying")
    return first.union(links_in_groups(grouped, pairs, percent))


def qualified(grouped: DataFrame, asks: DataFrame, percent: int) -> DataFrame:
    """(cid, to) of the asks whose class may reach the threshold in the group, by the stored union of the group's tokens."""
    met = grouped.join(asks.select(F.col("to").alias("grp")).distinct(), "grp", "left_semi")  # no class may meet the others
    union = written(met.groupBy(F.col("grp").alias("u_grp")).agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("tokens")), "unions")
    many = asks.groupBy(F.col("to").alias("u_grp")).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
    asking = asks.join(many, asks["to"] == many["u_grp"]).join(grouped.select("cid", "n", "tokens"), "cid").select("cid", "to", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"), "n", "tokens")
    asked = union.join(many, "u_grp").select("u_grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("u_part"), "tokens")
    return asking.groupBy("to", "part").cogroup(asked.groupBy("u_grp", "u_part")).applyInPandas(qualifying(percent), "cid long, to long").distinct()


def opened_groups(grouped: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes that ask and the members of the groups that they open, both dealt by group and by part of its many askers."""
    many = pairs.groupBy(F.col("to").alias("grp")).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
    asking = pairs.join(many, pairs["to"] == many["grp"]).join(grouped.select("cid", "n", "label", "tokens"), "cid")
    asking = asking.select(F.col("grp").alias("q_grp"), F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("q_part"), F.col("n").alias("q_n"), F.col("label").alias("q_label"), F.col("tokens").alias("q_tokens"))
    members = grouped.join(many, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cid", "n", "label", "tokens")
    return asking, members


def links_in_groups(grouped: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Links between labels from the opened groups.

    A label is a class of its component, so links between labels join on to the links between classes.
    """
    asking, members = opened_groups(grouped, pairs)
    return asking.groupBy("q_grp", "q_part").cogroup(members.groupBy("grp", "part")).applyInPandas(opened(percent), PAIR)


def near_duplicate_classes(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 2 << 20) -> DataFrame:
    """One row per document: its id, n_shingles (size of its set) and component_id (least id reachable by links, itself included).

    Two documents link when ``100 * intersection >= percent * union`` over their sets of ``size``-word shingles.
    """
    ids = WholeIds(docs, id_col)
    blocks = Blocks(ids.docs, id_col, text_col, block_bytes)
    sketch = Sketch(max(1, blocks.bytes // 6), blocks.count)

    def features(_: int, pdf: pd.DataFrame, got: dict) -> pd.DataFrame:
        token, text = shingle_sets(texts_of(pdf), size)
        held = sketch.estimates(token, got)
        shared = held >= 2
        n = np.bincount(text, minlength=len(pdf))
        s = np.bincount(text[shared], minlength=len(pdf))
        open_ = (n > 0) & (100 * s >= percent * n)
        use = shared & open_[text]
        token, text, held = token[use], text[use], held[use]
        order = np.lexsort((token, held, text))
        token, text = token[order], text[order]
        cuts = np.searchsorted(text, np.arange(len(pdf) + 1))
        hi, lo = (np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mix(token * c1 ^ c2), dtype=np.uint64))) for c1, c2 in (COEFFICIENTS[0, 4020:4022], COEFFICIENTS[0, 4022:4024]))
        hi, lo = ((x[cuts[1:]] - x[cuts[:-1]]).view(np.int64) for x in (hi, lo))
        seen: set = set()
        lists = []
        for i, ok in enumerate(open_.tolist()):
            key = (int(hi[i]), int(lo[i]), int(n[i]))
            lists.append(token[cuts[i] : cuts[i + 1]].view(np.int64) if ok and key not in seen else None)  # once for each class and block
            seen.add(key)
        return pd.DataFrame({"ord": pdf["ord"], "n": n, "shared": np.where(open_, s, -1), "key_hi": hi, "key_lo": lo, "tokens": lists})

    answers = sketch.exchange(blocks, lambda pdf: shingle_sets(texts_of(pdf), size)[0])
    found = written(blocks.answered(answers, features, FEATURES), "shingles")
    alive = found.filter("shared >= 0")
    key = ["key_hi", "key_lo", "n"]
    named = alive.groupBy(key).agg(F.min("ord").alias("cid"), F.count(F.lit(1)).alias("members"))
    with_tokens = alive.filter("tokens is not null").select(F.col("ord").alias("cid"), *key, "tokens")
    classes = written(with_tokens.join(named, [*key, "cid"]).dropDuplicates([*key, "cid"]).select("cid", "members", "tokens", *key), "classes")

    with passing(classes.sparkSession) as made:
        labels = components(links_between(classes, percent))
        made.pop()  # the labels; what they were made from goes
    sized = labels.withColumnRenamed("label", "component")
    linked = classes.drop("tokens").join(sized, classes["cid"] == sized["node"], "left").select(*key, "cid", "members", "component")
    # Unlinked members of one class share just ``shared`` shingles, all others being unique to each.
    label = F.when(F.col("component").isNotNull(), F.col("component")).when((F.col("members") > 1) & (F.col("shared") * 100 >= (2 * F.col("n") - F.col("shared")) * percent), F.col("cid")).otherwise(F.col("ord"))
    joined = alive.drop("tokens").join(linked, key).select("ord", "n", label.alias("label"))
    out = joined.union(found.filter("shared < 0").select("ord", "n", "ord"))
    real = lambda c: F.when(F.col(c) != LAST, F.col(c)).cast(blocks.id_type)
    out = out.select(real("ord").alias(id_col), F.col("n").alias("n_shingles"), real("label").alias("component_id"))
    return ids.named(out, id_col, "component_id")
