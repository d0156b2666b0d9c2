"""D1/G1 exact blob match, D4-D6 fallback hash tiers, D7 fuzzy tier, D8 the
cascade, F1-F3 ranking and the preferred commit, for a whole table of query
files at once.

Work is keyed by *content group*, not by query: queries with the same
LF-normalised content (and base name) share one group, and every candidate
list is computed once per group. A group of identical files that holds a
third of all rows therefore costs one group row and one candidate list, not
a quadratic number of (query, commit) rows. Per query, only counts and the
preferred commit are derived (with the query's own commit removed when
``self_commit`` is given, using the group's top two).

A query may come with a hint path (column ``hint``), which stands first among
its candidate paths. What the hint changes is kept as an overlay: the commits
that touch it, or hold it among the name's touched commits, with the versions
and order they have for that (name, hint). The group's list is ranked once and
never copied; the overlay names the ranks that it hides, so the best candidates
left of the list are the smallest ranks it doesn't name."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from blobtrail.functions.content import blob_ids_lf_crlf, decode_ignore, normalize_lf
from blobtrail.functions.tokens import DEFAULT_K, DEFAULT_N, DEFAULT_WINDOW
from blobtrail.functions.fingerprints import DEFAULT_PERM
from blobtrail.operators import history as H
from blobtrail.operators.fingerprint_tables import with_fingerprint, with_stream
from blobtrail.operators.pairs import minhash_pairs, set_pairs, simhash_pairs, simhash_reach
from blobtrail.operators.ranking import ordered_rank
from blobtrail.operators.tiles import nearest_two
from blobtrail.session import written

EXACT, HASH, FUZZY = 1, 2, 3
QUERY_COLUMNS = ["query_id", "name", "hint", "over", "blob_norm", "blob_raw", "self_commit"]
MODE_NAME = {EXACT: "exact_blob", HASH: "normalized_path", FUZZY: "normalized_path"}


@dataclass
class MatchParams:
    similarity_mode: str = "jaccard"
    threshold: float = 0.92
    shingle_size: int = DEFAULT_K
    char_ngram_size: int = DEFAULT_N
    winnow_window: int = DEFAULT_WINDOW
    minhash_perm: int = DEFAULT_PERM
    crlf_variant: bool = False
    contains_only: bool = False  # keep only changes that add the blob


def prepare_queries(query_files: DataFrame, crlf: bool = True) -> DataFrame:
    """A1 + B1 + B4: LF-normalised content, both blob ids, file name.
    Output adds: content_lf, blob_norm, blob_raw, name, text."""
    dtype = query_files.schema["content"].dataType
    q = query_files.withColumn("content_lf", normalize_lf(F.col("content"), dtype))
    norm, raw = blob_ids_lf_crlf(F.col("content_lf"), dtype, crlf)
    return (
        q.withColumn("blob_norm", norm)
        .withColumn("blob_raw", raw)
        .withColumn("name", file_name(F.col("path"), F.col("hint") if "hint" in query_files.columns else None))
        .withColumn("text", decode_ignore(F.col("content_lf"), dtype))
    )


def file_name(path: Column, hint: Column | None = None) -> Column:
    """The base name to look for: the file's own or, where it has none (as
    from standard input), its hint path's; null where neither has one."""
    own = H.basename(path)
    return own if hint is None else F.coalesce(F.nullif(own, F.lit("")), F.nullif(H.basename(hint), F.lit("")))


def exact_hits(groups: DataFrame, changes: DataFrame, contains_only: bool = False) -> DataFrame:
    """D1 + G1 per distinct (blob_norm, blob_raw): commits whose change adds
    or removes either id, LF hits before CRLF hits, each in log order.
    Output: (blob_norm, commit_id, o) with o the sortable order key."""
    keys = groups.select("blob_norm", "blob_raw").distinct()
    ids = keys.select("blob_norm", F.col("blob_norm").alias("blob_id"), F.lit(0).alias("src")).unionByName(
        keys.where(F.col("blob_raw") != F.col("blob_norm")).select(
            "blob_norm", F.col("blob_raw").alias("blob_id"), F.lit(1).alias("src")
        )
    )
    ch = changes.select("blob_id", "commit_id", "log_ord", "kind")
    if contains_only:
        ch = ch.where(F.col("kind") == "add")
    hits = ids.join(ch.drop("kind"), "blob_id")
    return hits.groupBy("blob_norm", "commit_id").agg(
        F.min(F.struct(F.lit(0.0).alias("neg_score"), F.col("src").cast("long").alias("r1"),
                       F.col("log_ord").cast("long").alias("r2"), F.lit(0).cast("long").alias("r3"))).alias("o")
    )


def _touch_order(touch_ord: Column, neg_score: Column | None = None) -> Column:
    return F.struct(
        (neg_score if neg_score is not None else F.lit(0.0)).alias("neg_score"),
        touch_ord["path_rank"]["tier"].cast("long").alias("r1"),
        touch_ord["path_rank"]["ord"].cast("long").alias("r2"),
        touch_ord["log_ord"].cast("long").alias("r3"),
    )


def fallback_parts(
    groups: DataFrame,
    file_versions: DataFrame,
    changes: DataFrame,
    path_objects: DataFrame,
) -> dict[str, DataFrame]:
    """D2-D6 per content group (name, blob_norm, blob_raw).

    Returns the intermediate tables: ``paths`` (C1/C2 per name), ``touched``
    (D2/D3), ``d4`` (blob-id hits), ``first`` (D5 with the id ``nblob`` of
    its LF-normalised content), ``d6`` (content-hash hits) and ``hash`` (D4
    or D6 per group, with the order key ``o``)."""
    names = groups.select("name").distinct()
    # Candidate paths per name; D2/D3: touched commits per name.
    paths = H.discover_paths(names, path_objects.select("path", "ord"), "name").select(
        "name", "path", F.struct(F.lit(1).alias("tier"), F.col("path_ord").alias("ord")).alias("path_rank")
    )
    touched = written(H.commits_touching(paths, changes, key="name"))
    # Versions of candidate paths (a path has one base name, so one row per
    # version), kept at touched commits. Both D4 and D5 read this table.
    fv = file_versions.select("commit_id", "path", "blob_id")
    at = written(fv.join(paths, "path").join(touched, ["name", "commit_id"]))

    return {"paths": paths, "touched": touched, **hash_parts(at, groups, file_versions)}


def hash_parts(at: DataFrame, groups: DataFrame, file_versions: DataFrame) -> dict[str, DataFrame]:
    """D4 to D6 of content groups from ``at``, the versions of candidate paths
    at touched commits."""
    ids = groups.select("name", "blob_norm", F.col("blob_norm").alias("id")).unionByName(
        groups.select("name", "blob_norm", F.col("blob_raw").alias("id"))
    ).distinct()

    # Any candidate path at the commit already has one of the ids (C3: a
    # stored id that isn't whole is none).
    d4 = at.select("name", "commit_id", H.valid_blob_id(F.col("blob_id")).alias("id"), "touch_ord").join(ids, ["name", "id"])
    # First existing candidate path per (name, commit); D6: its content,
    # LF-normalised, hashed where it is read. Contents aren't joined.
    first = H.first_versions_at(at)
    cdtype = file_versions.schema["content"].dataType
    nblob = blob_ids_lf_crlf(normalize_lf(F.col("content"), cdtype), cdtype, crlf=False)[0]
    first = written(first.join(file_versions.select("commit_id", "path", nblob.alias("nblob")), ["commit_id", "path"]))
    d6 = first.select("name", "commit_id", F.col("nblob").alias("id"), "touch_ord").join(ids, ["name", "id"])

    hash_hits = (
        d4.unionByName(d6)
        .groupBy("name", "blob_norm", "commit_id")
        .agg(F.min(_touch_order(F.col("touch_ord"))).alias("o"))
    )
    return {"ids": ids, "d4": d4, "first": first, "d6": d6, "hash": hash_hits}


def overlay_name(name: Column, hint: Column) -> Column:
    """One key for a (name, hint), which stands for the name in an overlay."""
    return F.to_json(F.struct(name.alias("name"), hint.alias("hint")))


def overlay_parts(groups: DataFrame, parts: dict, file_versions: DataFrame, changes: DataFrame) -> dict[str, DataFrame]:
    """The tables of ``hash_parts`` for groups (name, hint, blob_norm,
    blob_raw) where their hint makes a difference, their name being the
    ``overlay_name``, and ``hidden``: the commits (name, commit_id) whose row
    in the name's own list doesn't count for them."""
    each = written(groups.select("name", "hint", overlay_name(F.col("name"), F.col("hint")).alias("over")).distinct())
    rank = F.struct(F.lit(0).alias("tier"), F.lit(0).cast("long").alias("ord"))
    hints = each.select("hint").distinct().select("hint", F.col("hint").alias("path"), rank.alias("path_rank"))
    by_hint = H.commits_touching(hints, changes, key="hint")
    fv = file_versions.select("commit_id", "path", "blob_id")
    at_hint = written(fv.join(hints.select("path", "hint"), "path"))
    inside = at_hint.select("hint", "commit_id").join(each, "hint").join(parts["touched"], ["name", "commit_id"])
    rows = each.join(by_hint, "hint").select("over", "name", "hint", "commit_id", "touch_ord").unionByName(inside.select("over", "name", "hint", "commit_id", "touch_ord"))
    hidden = written(rows.groupBy("over", "name", "hint", "commit_id").agg(F.min("touch_ord").alias("touch_ord")))
    own = at_hint.join(hidden, ["hint", "commit_id"]).select("over", "commit_id", "path", "blob_id", rank.alias("path_rank"), "touch_ord")
    others = fv.join(parts["paths"], "path").join(hidden, ["name", "commit_id"]).where("path <> hint").select("over", "commit_id", "path", "blob_id", "path_rank", "touch_ord")
    at = written(own.unionByName(others).withColumnRenamed("over", "name"))
    named = groups.select(overlay_name(F.col("name"), F.col("hint")).alias("name"), "blob_norm", "blob_raw").distinct()
    return {"hidden": hidden.select(F.col("over").alias("name"), "commit_id"), **hash_parts(at, named, file_versions)}


def fuzzy_tier(groups: DataFrame, parts: dict, file_versions: DataFrame, p: MatchParams) -> DataFrame:
    """D7 + C4 per content group on distinct contents. Version contents are
    keyed by (name, nblob); a version whose normalised id equals a query id
    is a hash hit, never a fuzzy one. Output: (name, blob_norm, commit_id,
    score, o)."""
    return _at_commits(fuzzy_scores(groups, parts, file_versions, p), parts)


def _at_commits(scored: DataFrame, parts: dict) -> DataFrame:
    return (
        scored.join(parts["first"].select("name", "nblob", "commit_id", "touch_ord"), ["name", "nblob"])
        .select("name", "blob_norm", "commit_id", "score", _touch_order(F.col("touch_ord"), -F.col("score")).alias("o"))
    )


def fuzzy_scores(groups: DataFrame, parts: dict, file_versions: DataFrame, p: MatchParams) -> DataFrame:
    """(name, blob_norm, nblob, score) at or above the threshold."""
    scored = similarity_pairs_by_content(groups.select("name", "blob_norm", "text"), parts["first"], file_versions, p)
    return _not_equal(scored, parts)


def _not_equal(scored: DataFrame, parts: dict) -> DataFrame:
    return scored.join(parts["ids"].withColumnRenamed("id", "nblob"), ["name", "blob_norm", "nblob"], "left_anti")


def overlay_fuzzy_tier(groups: DataFrame, over: dict, file_versions: DataFrame, p: MatchParams) -> DataFrame:
    """``fuzzy_tier`` of overlays, for groups (over, name, hint, blob_norm,
    text). An overlay's versions lie at its hint path or under its name, so
    contents are compared once per hint path and once per name, however many
    overlays share them."""
    by_name, by_hint = F.concat(F.lit("n:"), F.col("name")), F.concat(F.lit("h:"), F.col("hint"))
    sides = written(groups.select("over", "blob_norm", F.explode(F.array(by_name, by_hint)).alias("block")))
    keys = groups.select("over", "name", "hint").distinct().withColumnsRenamed({"name": "_name", "hint": "_hint"})
    block = F.when(F.col("path") == F.col("_hint"), F.concat(F.lit("h:"), F.col("_hint"))).otherwise(F.concat(F.lit("n:"), F.col("_name")))
    at = over["first"].withColumnRenamed("name", "over").join(keys, "over")
    versions = written(at.select("over", block.alias("block"), "nblob", "commit_id", "path"))
    texts = groups.select("blob_norm", "text").dropDuplicates(["blob_norm"])
    asked = sides.select("block", "blob_norm").distinct().join(texts, "blob_norm")
    scored = written(similarity_pairs_by_content(asked.withColumnRenamed("block", "name"), versions.withColumnRenamed("block", "name"), file_versions, p))
    wanted = scored.withColumnRenamed("name", "block").join(sides, ["block", "blob_norm"])
    wanted = wanted.join(versions.select("over", "block", "nblob").distinct(), ["over", "block", "nblob"])
    each = wanted.groupBy(F.col("over").alias("name"), "blob_norm", "nblob").agg(F.max("score").alias("score"))
    return _at_commits(_not_equal(each, over), over)


def similarity_pairs_by_content(queries: DataFrame, versions: DataFrame, file_versions: DataFrame, p: MatchParams) -> DataFrame:
    """Scores of (query content, version content) pairs of the same name with
    score >= threshold, in the chosen mode; a content isn't compared to itself
    (that is a hash hit). Output: (name, blob_norm, nblob, score).

    ``queries``: (name, blob_norm, text); ``versions``: (name, nblob, commit_id,
    path)."""
    return _similar(*content_fingerprints(queries, versions, file_versions, p), p)


def content_fingerprints(queries: DataFrame, versions: DataFrame, file_versions: DataFrame, p: MatchParams) -> tuple[DataFrame, DataFrame]:
    """(name, key, fp) of the distinct contents of both sides (for charjaccard fp
    is the token stream). A text that
    stands on both has its fingerprint made once: texts meet by their own hash,
    as keys may stand for several where versions repeat."""
    mode, cdtype = p.similarity_mode, file_versions.schema["content"].dataType
    kw = dict(k=p.shingle_size, n=p.char_ngram_size, window=p.winnow_window, num_perm=p.minhash_perm)
    made = lambda df: with_stream(df, "text") if mode == "charjaccard" else with_fingerprint(df, "text", mode, **kw)
    text_id = F.coalesce(F.sha1(F.encode("text", "UTF-8")), F.lit("")).alias("text_id")
    qtext = queries.select("name", F.col("blob_norm").alias("key"), "text").dropDuplicates(["name", "key"])
    ql = made(qtext.select("*", text_id))
    # One version stands for each distinct content of a name.
    rep = versions.groupBy("name", F.col("nblob").alias("key")).agg(F.min(F.struct("commit_id", "path")).alias("v")).select("name", "key", "v.*")
    content = file_versions.select("commit_id", "path", decode_ignore(normalize_lf(F.col("content"), cdtype), cdtype).alias("text"))
    content = content.select("commit_id", "path", "text", text_id)
    vids = written(rep.join(content.drop("text"), ["commit_id", "path"]).select("name", "key", "text_id"))
    known = ql.select("text_id", "fp").dropDuplicates(["text_id"])
    others = vids.select("text_id").distinct().join(ql.select("text_id").distinct(), "text_id", "left_anti")
    others = content.select("text_id", "text").join(others, "text_id", "left_semi").dropDuplicates(["text_id"])
    new = made(others).select("text_id", "fp")
    vr = written(vids.join(known, "text_id").unionByName(vids.join(new, "text_id")).select("key", "name", "fp"))
    return ql.select("key", "name", "fp"), vr


def _similar(ql: DataFrame, vr: DataFrame, p: MatchParams) -> DataFrame:
    mode = p.similarity_mode
    if mode == "minhash":
        pairs = minhash_pairs(ql, vr, p.threshold, p.minhash_perm, sig="fp", block="name", skip_equal_keys=True)
    elif mode == "simhash":
        pairs = simhash_pairs(ql, vr, p.threshold, fp="fp", block="name", skip_equal_keys=True)
    elif mode == "charjaccard":
        pairs = set_pairs(ql, vr, p.threshold, items="fp", block="name", skip_equal_keys=True, by="sketch", grams=max(1, int(p.char_ngram_size)))
    else:
        pairs = set_pairs(ql, vr, p.threshold, items="fp", block="name", skip_equal_keys=True)
    return pairs.select("name", F.col("l_key").alias("blob_norm"), F.col("r_key").alias("nblob"), "score")


def preference_key(o: Column, is_priority: Column, ts: Column) -> Column:
    """F3 as one sortable key: first candidate (by order) on a priority
    branch; otherwise the newest timestamp, ties to the earlier candidate."""
    prio = F.coalesce(is_priority, F.lit(False))
    return F.struct(
        F.when(prio, 0).otherwise(1).alias("p"),
        F.when(prio, o).alias("po"),
        F.when(~prio, -ts).alias("nts"),
        o.alias("o"),
    )


def choose_preferred(hits: DataFrame, gkeys: list[str], attrs: DataFrame) -> DataFrame:
    """F3 per group: (gkeys..., n, preferred)."""
    return _top2(hits, gkeys, attrs).select(*gkeys, "n", F.col("c1").alias("preferred"))


def _top2(hits: DataFrame, gkeys: list[str], attrs: DataFrame) -> DataFrame:
    """Per group: count, best and second-best candidate under F3. The row
    limit of the window runs before its shuffle too, and the count is a
    partial aggregation, so a hot group never lands whole in one task."""
    pk = F.struct(preference_key(F.col("o"), F.col("is_priority"), F.coalesce(F.col("ts"), F.lit(0))).alias("k"), "commit_id")
    ranked = hits.join(attrs, "commit_id", "left").select(*gkeys, "commit_id", pk.alias("pk"))
    return hits.groupBy(*gkeys).agg(F.count(F.lit(1)).alias("n")).join(_best2(ranked, gkeys), gkeys)


def _best2(ranked: DataFrame, gkeys: list[str]) -> DataFrame:
    two = ranked.withColumn("_rn", F.row_number().over(Window.partitionBy(*gkeys).orderBy("pk"))).where("_rn <= 2")
    return two.groupBy(*gkeys).agg(
        F.max(F.when(F.col("_rn") == 1, F.col("commit_id"))).alias("c1"), F.max(F.when(F.col("_rn") == 2, F.col("commit_id"))).alias("c2")
    )


def _settle(queries: DataFrame, hits: DataFrame, gkeys: list[str], attrs: DataFrame, tier: int) -> DataFrame:
    """``queries`` with this tier's outcome: candidates_count without the
    query's own commit, preferred, and ``tier`` where any candidate is left.
    Written, so the next tier starts from it."""
    own = hits.select(*gkeys, F.col("commit_id").alias("self_commit"), F.lit(1).alias("_own"))
    return _settle_by(queries, _top2(hits, gkeys, attrs), own, gkeys, tier)


def _settle_by(queries: DataFrame, top: DataFrame, own: DataFrame, gkeys: list[str], tier: int) -> DataFrame:
    """``_settle`` from (gkeys, n, c1, c2) and the queries' own hits."""
    s = queries.join(top, gkeys, "left").join(own, [*gkeys, "self_commit"], "left")
    count = F.coalesce("n", F.lit(0)) - F.coalesce("_own", F.lit(0))
    preferred = F.when(F.col("c1") == F.col("self_commit"), F.col("c2")).otherwise(F.col("c1"))
    return written(
        s.select(
            *QUERY_COLUMNS,
            F.when(count > 0, tier).alias("tier"), F.when(count > 0, preferred).alias("preferred"), count.cast("long").alias("candidates_count"),
        )
    )


def _settle_simhash(queries: DataFrame, ql: DataFrame, vr: DataFrame, first: DataFrame, attrs: DataFrame, threshold: float) -> DataFrame:
    """``_settle`` for the fuzzy tier by SimHash, whose pairs are a share of all
    pairs of a name: counts and the best two come from tiles, no pair is
    written. Of a content's versions the first two can be among the best, at
    whatever distance."""
    most = simhash_reach(threshold)
    gkeys, unit = ["name", "blob_norm"], ["name", "nblob", "fp"]
    versions = vr.withColumnRenamed("key", "nblob").join(first.select("name", "nblob", "commit_id", "touch_ord"), ["name", "nblob"])
    at = written(versions.select(*unit, "commit_id", _touch_order(F.col("touch_ord")).alias("o")))
    prio, ts = F.coalesce(F.col("is_priority"), F.lit(False)), F.coalesce(F.col("ts"), F.lit(0)).cast("long")
    seen = at.join(attrs, "commit_id", "left").select(*unit, "commit_id", "o", prio.alias("is_priority"), ts.alias("ts"))
    order = [preference_key(F.col("o"), F.col("is_priority"), F.col("ts")), F.col("commit_id")]
    two = seen.withColumn("_rn", F.row_number().over(Window.partitionBy(*unit).orderBy(*order))).where("_rn <= 2")
    counted = two.join(at.groupBy(*unit).agg(F.count(F.lit(1)).alias("_n")), unit)
    entries = written(counted.select(*unit, F.when(F.col("_rn") == 1, F.col("_n")).otherwise(0).alias("w"), "commit_id", "is_priority", "ts", "o.r1", "o.r2", "o.r3"))
    near = written(nearest_two(ql.where("key IS NOT NULL"), entries, most).withColumnRenamed("key", "blob_norm"))
    o = F.struct((F.col("d") / 64.0 - 1.0).alias("neg_score"), "r1", "r2", "r3")
    pk = F.struct(preference_key(o, F.col("is_priority"), F.col("ts")).alias("k"), "commit_id")
    top = _best2(near.select(*gkeys, "commit_id", pk.alias("pk")), gkeys)
    top = near.groupBy(*gkeys).agg(F.sum("n").alias("n")).join(top, gkeys)
    # The queries' own commits among the hits.
    asked = queries.select(*gkeys, "self_commit").distinct().join(ql.select("name", F.col("key").alias("blob_norm"), F.col("fp").alias("_fp")), gkeys)
    own = asked.join(at.withColumnRenamed("commit_id", "self_commit"), ["name", "self_commit"])
    own = own.where((F.bit_count(F.col("fp").bitwiseXOR(F.col("_fp"))) <= most) & (F.col("nblob") != F.col("blob_norm")))
    return _settle_by(queries, top, own.select(*gkeys, "self_commit", F.lit(1).alias("_own")), gkeys, FUZZY)


def _settle_overlaid(queries: DataFrame, hits: DataFrame, over: DataFrame, hidden: DataFrame, attrs: DataFrame, tier: int) -> DataFrame:
    """``_settle`` for queries with a hint (column ``over``): of the group's
    list ``hits`` the commits in ``hidden`` don't count, the overlay's own hits
    ``over`` (name = overlay name) do."""
    gkeys, okeys = ["name", "blob_norm"], ["over", "blob_norm"]
    groups = written(queries.select("name", *okeys).distinct())
    pk = F.struct(preference_key(F.col("o"), F.col("is_priority"), F.coalesce(F.col("ts"), F.lit(0))).alias("k"), "commit_id")
    wanted = hits.join(groups.select(*gkeys).distinct(), gkeys, "left_semi").join(attrs, "commit_id", "left")
    ranked = written(ordered_rank(wanted.select(*gkeys, "commit_id", pk.alias("pk")), gkeys, [F.col("pk")]))
    # A candidate meets the overlays that hide its commit, not each group all
    # commits that its overlay hides.
    named = hidden.withColumnRenamed("name", "over").join(groups.select("over", "name").distinct(), "over")
    gone = ranked.select(*gkeys, "commit_id", "rank").join(named, ["name", "commit_id"]).join(groups.select(*okeys), okeys)
    gone = written(ordered_rank(gone.select(*okeys, "commit_id", "rank"), okeys, [F.col("rank")], "_i"))
    # The k-th rank that isn't gone: k and the gone ones with fewer than k
    # free ranks before them.
    before = F.col("rank") - F.col("_i")
    free = gone.groupBy(*okeys).agg(F.count(F.lit(1)).alias("n_gone"), *[F.count_if(before < k).alias(f"g{k}") for k in (1, 2)])
    left = groups.join(free, okeys, "left").na.fill(0, ["n_gone", "g1", "g2"])
    best = left.select(*gkeys, "over", F.explode(F.array(F.col("g1") + 1, F.col("g2") + 2)).alias("rank")).join(ranked, [*gkeys, "rank"])
    ours = over.withColumnRenamed("name", "over").join(groups, okeys).join(attrs, "commit_id", "left").select(*okeys, "commit_id", pk.alias("pk"))
    both = best.select(*okeys, "commit_id", "pk").unionByName(ours)
    two = both.withColumn("_rn", F.row_number().over(Window.partitionBy(*okeys).orderBy("pk"))).where("_rn <= 2")
    picks = two.groupBy(*okeys).agg(F.max(F.when(F.col("_rn") == 1, F.col("commit_id"))).alias("c1"), F.max(F.when(F.col("_rn") == 2, F.col("commit_id"))).alias("c2"))
    in_list = ranked.groupBy(*gkeys).agg(F.count(F.lit(1)).alias("n_list"))
    in_over = ours.groupBy(*okeys).agg(F.count(F.lit(1)).alias("n_over"))
    counts = left.join(in_list, gkeys, "left").join(in_over, okeys, "left").na.fill(0, ["n_list", "n_over"])
    counts = counts.select(*okeys, (F.col("n_list") - F.col("n_gone") + F.col("n_over")).alias("n")).join(picks, okeys, "left")
    own = lambda df, keys, name: df.select(*keys, F.col("commit_id").alias("self_commit"), F.lit(1).alias(name))
    s = (
        queries.join(counts, okeys, "left")
        .join(own(ranked, gkeys, "_listed"), [*gkeys, "self_commit"], "left")
        .join(own(gone, okeys, "_gone"), [*okeys, "self_commit"], "left")
        .join(own(ours, okeys, "_ours"), [*okeys, "self_commit"], "left")
    )
    mine = F.coalesce("_listed", F.lit(0)) - F.coalesce("_gone", F.lit(0)) + F.coalesce("_ours", F.lit(0))
    count = F.coalesce("n", F.lit(0)) - mine
    preferred = F.when(F.col("c1") == F.col("self_commit"), F.col("c2")).otherwise(F.col("c1"))
    return written(
        s.select(
            *QUERY_COLUMNS,
            F.when(count > 0, tier).alias("tier"), F.when(count > 0, preferred).alias("preferred"), count.cast("long").alias("candidates_count"),
        )
    )


def match_cascade(
    query_files: DataFrame,
    file_versions: DataFrame,
    changes: DataFrame,
    path_objects: DataFrame,
    commit_attrs: DataFrame,
    params: MatchParams | None = None,
) -> dict[str, DataFrame]:
    """D8 for a table of query files.

    ``query_files``: (query_id, path, content[, self_commit][, hint]).
    ``commit_attrs``: (commit_id, ts long, is_priority boolean).

    Each tier is computed once, written, and only for the groups that some
    query left open: a query is open while it has no hit but its own commit.
    Returns ``summary`` (one row per query; ``reason`` tells the two kinds of
    no match apart) and ``candidates`` (one row per (group, commit) of the
    tier that settled some query of it), plus the tier tables. Where hints are
    given, ``overlay`` holds their own candidates (name = overlay name) and
    ``hidden`` the commits of a name's list that don't count for them."""
    p = params or MatchParams()
    hints = "hint" in query_files.columns
    q = prepare_queries(query_files, p.crlf_variant)
    if "self_commit" not in q.columns:
        q = q.withColumn("self_commit", F.lit(None).cast(file_versions.schema["commit_id"].dataType))
    hint = F.nullif(F.col("hint"), F.lit("")) if hints else F.lit(None).cast("string")
    q = q.withColumn("hint", hint).withColumn("over", F.when(F.col("hint").isNotNull(), overlay_name(F.col("name"), F.col("hint"))))
    base = written(q.select(*QUERY_COLUMNS))
    gkeys = ["name", "blob_norm"]

    exact = written(exact_hits(base, changes, p.contains_only))
    by_exact = _settle(base, exact, ["blob_norm"], commit_attrs, EXACT)
    left = by_exact.where("tier IS NULL")
    parts = fallback_parts(left.select(*gkeys, "blob_raw").distinct(), file_versions, changes, path_objects)
    hashed = written(parts["hash"])
    over = overlay_parts(left.where("over IS NOT NULL").select("name", "hint", "blob_norm", "blob_raw").distinct(), parts, file_versions, changes) if hints else None
    over_hashed = written(over["hash"]) if hints else None

    def settle(queries: DataFrame, hits: DataFrame, over_hits: DataFrame | None, tier: int) -> DataFrame:
        if not hints:
            return _settle(queries, hits, gkeys, commit_attrs, tier)
        plain = _settle(queries.where("over IS NULL"), hits, gkeys, commit_attrs, tier)
        return plain.unionByName(_settle_overlaid(queries.where("over IS NOT NULL"), hits, over_hits, over["hidden"], commit_attrs, tier))

    by_hash = settle(left, hashed, over_hashed, HASH)
    left = by_hash.where("tier IS NULL")
    still = left.select(*gkeys).distinct()
    groups = q.select(*gkeys, "text").join(still, gkeys, "left_semi").dropDuplicates(gkeys)
    # SimHash lists are as long as a share of all pairs: they are made where
    # they are read, counts and preferred commits without them.
    listed = p.similarity_mode != "simhash" or hints
    ql, vr = content_fingerprints(groups.select("name", "blob_norm", "text"), parts["first"], file_versions, p)
    fuzzy = _at_commits(_not_equal(_similar(ql, vr, p), parts), parts)
    fuzzy = written(fuzzy) if listed else fuzzy
    over_fuzzy = None
    if hints:
        open_ = left.where("over IS NOT NULL").select("over", "blob_norm").distinct()
        over_groups = q.select("over", "name", "hint", "blob_norm", "text").join(open_, ["over", "blob_norm"], "left_semi").dropDuplicates(["over", "blob_norm"])
        over_fuzzy = written(overlay_fuzzy_tier(over_groups, over, file_versions, p))
    if listed:
        by_fuzzy = settle(left, fuzzy.drop("score"), over_fuzzy.drop("score") if hints else None, FUZZY)
    else:
        by_fuzzy = _settle_simhash(left, ql, vr, parts["first"], commit_attrs, p.threshold)

    settled = by_exact.where("tier IS NOT NULL").unionByName(by_hash.where("tier IS NOT NULL")).unionByName(by_fuzzy)
    with_paths = parts["paths"].select("name").distinct().withColumn("_paths", F.lit(True))
    summary = settled.join(with_paths, "name", "left").select(
        "query_id",
        F.when(F.col("tier") == EXACT, MODE_NAME[EXACT]).when(F.col("tier").isNotNull(), MODE_NAME[HASH]).otherwise("no_match").alias("mode"),
        "tier",
        F.lit(p.similarity_mode).alias("similarity_mode"),
        F.col("blob_norm").alias("local_blob_norm"),
        F.col("blob_raw").alias("local_blob_raw"),
        "preferred",
        F.when(F.col("tier").isNotNull(), F.col("candidates_count")).otherwise(0).alias("candidates_count"),
        F.when(F.col("tier").isNull(), F.when(F.col("_paths") | F.col("hint").isNotNull(), "no candidates").otherwise("no candidate paths")).alias("reason"),
        "name",
        "hint",
        "self_commit",
    )
    # Candidate lists per group, only for the tier that settled some query.
    no_name, no_score = F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("score")
    need_exact = by_exact.where("tier IS NOT NULL").select("blob_norm").distinct()
    need_hash = by_hash.where("tier IS NOT NULL").select(*gkeys).distinct()
    need_fuzzy = by_fuzzy.where("tier IS NOT NULL").select(*gkeys).distinct()
    candidates = (
        exact.join(need_exact, "blob_norm").select(no_name, "blob_norm", F.lit(EXACT).alias("tier"), "commit_id", "o", no_score)
        .unionByName(hashed.join(need_hash, gkeys).select(*gkeys, F.lit(HASH).alias("tier"), "commit_id", "o", no_score))
        .unionByName(fuzzy.join(need_fuzzy, gkeys).select(*gkeys, F.lit(FUZZY).alias("tier"), "commit_id", "o", "score"))
    )
    out = {"summary": summary, "candidates": candidates, "exact": exact, "hash": hashed, "fuzzy": fuzzy, "queries": q, "parts": parts}
    if hints:
        mine = over_hashed.select(*gkeys, F.lit(HASH).alias("tier"), "commit_id", "o", no_score)
        out["overlay"] = mine.unionByName(over_fuzzy.select(*gkeys, F.lit(FUZZY).alias("tier"), "commit_id", "o", "score"))
        out["hidden"] = over["hidden"]
    return out
