"""Fork catalog as table jobs over landed API pages (no HTTP here):
A3 read fork pages, G2 union of repo and parent forks, C5 usable forks,
F5 offset/limit window, F6 unique remote names, G3 upstream of a fork.

Lists are read whole unless ``max_forks`` is given (a run that will select
``limit`` forks from ``offset`` on needs no more than offset + limit; the
limit is at most 99). Positions and names are numbered without gathering a
target's list in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blobtrail.functions.text_format import sanitize_remote_name
from blobtrail.operators.ranking import ordered_rank
from blobtrail.session import written

# --- fixed values (the hosting API's paging and the reference's limits) -----
PER_PAGE = 100
MAX_LIMIT = 99
# ----------------------------------------------------------------------------

FORK_SCHEMA = (
    "array<struct<full_name:string,name:string,owner:struct<login:string>,"
    "clone_url:string,ssh_url:string,git_url:string>>"
)
REPO_SCHEMA = (
    "struct<fork:boolean,parent:struct<full_name:string,name:string,owner:struct<login:string>,"
    "clone_url:string,ssh_url:string,git_url:string>>"
)


def read_fork_pages(pages: DataFrame, max_forks: int | None = None, per_page: int = PER_PAGE) -> DataFrame:
    """A3. ``pages``: (target, src, page, body[, status]). Per (target, src)
    list, pages are read from 1 upwards; reading stops before a missing,
    failed, malformed, non-list or empty page, and after a short page; the
    list is cut at ``max_forks``, if given. Output: (target, src, ordinal, fork)."""
    p = pages
    if "status" not in p.columns:
        p = p.withColumn("status", F.lit(200))
    parsed = p.withColumn(
        "arr", F.when(F.ltrim(F.col("body")).startswith("["), F.from_json("body", FORK_SCHEMA))
    ).withColumn("n", F.size("arr"))
    bad = (F.col("status") != 200) | F.col("arr").isNull() | (F.col("n") <= 0)
    keys = ["target", "src"]
    present = parsed.select(*keys, "page")
    missing = (
        present.select(*keys, (F.col("page") + 1).alias("page"))
        .unionByName(present.select(*keys).distinct().withColumn("page", F.lit(1)))
        .join(present, keys + ["page"], "left_anti")
    )
    stops = (
        parsed.select(*keys, F.when(bad, F.col("page")).alias("bad_page"),
                      F.when(~bad & (F.col("n") < per_page), F.col("page")).alias("short_page"))
        .unionByName(missing.select(*keys, F.col("page").alias("bad_page"), F.lit(None).cast("int").alias("short_page")), allowMissingColumns=True)
        .groupBy(*keys)
        .agg(F.min("bad_page").alias("bad_page"), F.min("short_page").alias("short_page"))
    )
    # A list has a page that stops it: at the latest the one after its last.
    last = F.least(F.col("bad_page") - 1, F.col("short_page"))
    ok = parsed.join(stops.withColumn("last_page", last), keys).where(F.col("page") <= F.col("last_page"))
    forks = ok.select(*keys, "page", F.posexplode("arr").alias("pos", "fork"))
    # Pages before the last are full, so the ordinal needs no window.
    forks = forks.withColumn("ordinal", (F.col("page") - 1) * per_page + F.col("pos") + 1)
    if max_forks is not None:
        forks = forks.where(F.col("ordinal") <= max_forks)
    return forks.select(*keys, "ordinal", "fork")


def union_forks(forks: DataFrame) -> DataFrame:
    """G2 + F2: the repo's forks first, then the parent's, first occurrence of
    each non-empty full_name kept. Output: (target, pos, fork), pos 1-based."""
    rank = F.when(F.col("src") == "repo", 0).otherwise(1)
    fn = F.col("fork.full_name")
    firsts = (
        forks.where(fn.isNotNull() & (fn != ""))
        .withColumn("full_name", fn)
        .groupBy("target", "full_name")
        .agg(F.min(F.struct(rank.alias("r"), F.col("ordinal").alias("o"), F.col("fork").alias("fork"))).alias("m"))
    )
    ranked = ordered_rank(firsts.select("target", "m.*"), ["target"], [F.col("r"), F.col("o")], "pos")
    return ranked.select("target", "pos", "fork")


def fork_window(combined: DataFrame, offset: int, limit: int) -> DataFrame:
    """positions offset+1 .. offset+limit of the combined list (negative
    offsets clamp to 0; a limit above 99 is refused)."""
    if int(limit) > MAX_LIMIT:
        raise ValueError(f"forks limit cannot be greater than {MAX_LIMIT}")
    start = max(0, int(offset or 0))
    return combined.where((F.col("pos") > start) & (F.col("pos") <= start + max(0, int(limit))))


def first_nonempty(*cols: Column) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def usable_forks(selected: DataFrame, target_repo: Column) -> DataFrame:
    """Owner login (default 'fork'), repo name (default: the target's
    repo name), clone URL = first non-empty of clone/ssh/git URL; forks
    without any URL are skipped."""
    f = F.col("fork")
    return (
        selected.withColumn("owner_login", F.coalesce(F.nullif(f["owner"]["login"], F.lit("")), F.lit("fork")))
        .withColumn("repo_name", F.coalesce(F.nullif(f["name"], F.lit("")), target_repo))
        .withColumn("clone_url", first_nonempty(f["clone_url"], f["ssh_url"], f["git_url"]))
        .where(F.col("clone_url").isNotNull())
    )


NUMBERED = r"^(.*)_([1-9][0-9]{0,8})$"  # a name as the n-th choice of another base


def unique_remote_names(usable: DataFrame, existing: DataFrame) -> DataFrame:
    """remote name ``fork_<owner>_<repo>`` made safe; on a clash with an
    existing remote or an earlier fork of the same target, the first free
    ``<base>_1``, ``<base>_2``, ... (at most 200 characters).

    Forks of one base take its free numbers in order, so the k-th fork has the
    k-th number that nobody else holds: a rank, however many forks there are.
    Numbers are held by existing remotes, and by a fork whose own base reads
    like a numbered one (``x_3`` beside ``x``). Such a name goes to the earlier
    of that base's first fork and the one that ``x`` would give it to; these
    contests are settled in rounds, the lowest open number of each base whose
    own name is settled. Only contests take rounds, all bases at once.

    ``usable``: (target, pos, owner_login, repo_name, ...), pos unique in a
    target; ``existing``: (target, remote) names already present."""
    base = sanitize_remote_name(F.concat(F.lit("fork_"), F.col("owner_login"), F.lit("_"), F.col("repo_name")))
    key = ["target", "base"]
    items = ordered_rank(usable.select("target", "pos", base.alias("base")), key, [F.col("pos")], "_k")
    items = written(items.select(*key, "pos", (F.col("_k") - 1).alias("k")))
    bases = written(items.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first")))
    present = existing.select("target", F.col("remote").alias("name")).where("name IS NOT NULL").distinct()
    stem, number = F.regexp_extract("name", NUMBERED, 1).alias("base"), F.regexp_extract("name", NUMBERED, 2)
    numbered = number != ""
    as_number = number.cast("long").alias("j")
    held = present.select("target", F.col("name").alias("base"), F.lit(0).cast("long").alias("j")).unionByName(present.where(numbered).select("target", stem, as_number))
    held = written(held.join(bases.select(*key), key, "left_semi").distinct())
    named = bases.select("target", F.col("base").alias("name"), "first").where(numbered).join(present, ["target", "name"], "left_anti")
    open_ = written(named.select("target", stem, as_number, F.col("name").alias("child"), "first").join(bases.select(*key), key, "left_semi"))
    while not open_.isEmpty():
        unsettled = open_.select("target", F.col("child").alias("base"))
        lowest = open_.join(unsettled, key, "left_anti").groupBy(*key).agg(F.min(F.struct("j", "child", "first")).alias("c")).select(*key, "c.*")
        below = held.withColumnRenamed("j", "_j")
        free = lowest.join(below, key, "left").groupBy(*key, "j", "child", "first").agg(F.count_if(F.col("_j") < F.col("j")).alias("_held"))
        taker = free.withColumn("k", F.col("j") - F.col("_held")).join(items, [*key, "k"], "left")
        wins = F.col("pos").isNull() | (F.col("first") < F.col("pos"))
        settled = written(taker.select("target", F.when(wins, F.col("base")).otherwise(F.col("child")).alias("base"), F.when(wins, F.col("j")).otherwise(0).alias("j"), "child"))
        held = written(held.unionByName(settled.select(*key, "j")))
        open_ = written(open_.join(settled.select("target", "child"), ["target", "child"], "left_anti"))
    sizes = bases.join(held.groupBy(*key).agg(F.count(F.lit(1)).alias("m")), key, "left")
    numbers = sizes.select(*key, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") + F.coalesce("m", F.lit(0)) - 1)).alias("j")).join(held, [*key, "j"], "left_anti")
    given = ordered_rank(numbers, key, [F.col("j")], "_k").select(*key, "j", (F.col("_k") - 1).alias("k"))
    name = F.when(F.col("j") == 0, F.col("base")).otherwise(F.substring(F.concat("base", F.lit("_"), F.col("j").cast("string")), 1, 200))
    names = items.join(given, [*key, "k"]).select("target", "pos", name.alias("remote"))
    return usable.join(names, ["target", "pos"])


def upstream_of_fork(repos: DataFrame) -> DataFrame:
    """For a repository record that is a fork: the parent's owner/name
    (from full_name 'owner/name' split at the first '/', else owner.login and
    name) and the first non-empty of its clone/ssh/git URL; null otherwise.
    ``repos``: (repo_id, record struct per REPO_SCHEMA)."""
    par = F.col("record.parent")
    is_fork = F.coalesce(F.col("record.fork"), F.lit(False)) & par.isNotNull()
    fname = F.coalesce(par["full_name"], F.lit(""))
    has_slash = F.instr(fname, "/") > 0
    owner = F.when(has_slash, F.split(fname, "/", 2)[0]).otherwise(par["owner"]["login"])
    name = F.when(has_slash, F.split(fname, "/", 2)[1]).otherwise(par["name"])
    url = first_nonempty(par["clone_url"], par["ssh_url"], par["git_url"])
    return repos.select(
        "repo_id",
        is_fork.alias("is_fork"),
        F.when(is_fork, owner).alias("parent_owner"),
        F.when(is_fork, name).alias("parent_repo"),
        F.when(is_fork, url).alias("parent_url"),
        F.when(is_fork & F.nullif(owner, F.lit("")).isNotNull() & F.nullif(name, F.lit("")).isNotNull() & url.isNotNull(),
               sanitize_remote_name(F.concat(F.lit("upstream_"), owner, F.lit("_"), name))).alias("upstream_remote"),
    )
