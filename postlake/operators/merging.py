"""Merging vacancies with all that hangs on them, the journal of it, and the way back.

A batch of moves (merged, kept, signal) is applied to the tables of a vacancy's children, each by its own rule of conflict.
Tables are a dict of DataFrames; those a caller lacks may be left out. Columns that a rule doesn't name pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.operators.resolve import written

#: Statuses by how far a response has come.
STATUS = {"NOT_INTERESTED": 2, "APPLIED": 3, "INTERVIEW": 4, "REJECTED": 5}
#: Children of a vacancy, and what tells their rows apart.
CHILDREN = {
    "job_posting": ("id",), "vacancy_revision": ("id",), "status_history": ("id",), "delivered": ("condition_id", "vacancy_id"), "digest": ("user_id", "vacancy_id"),
    "user_status": ("user_id", "vacancy_id"), "position_match": ("vacancy_id", "position_id"), "language": ("vacancy_id", "language"),
}
PORTAL = "profesia:"


def _moved(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """rows with the vacancy they belong to after the moves, and was_merged."""
    m = moves.select(F.col("merged").alias("vacancy_id"), F.col("kept").alias("__kept"))
    return rows.join(m, "vacancy_id", "left").withColumn("was_merged", F.col("__kept").isNotNull()).withColumn("vacancy_id", F.coalesce("__kept", "vacancy_id")).drop("__kept").select(*rows.columns, "was_merged")


def reassigned(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Children whose rows simply follow: postings, revisions, history."""
    return _moved(rows, moves).drop("was_merged")


def dropped(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """Children that are made anew: those of merged vacancies go."""
    return rows.join(moves.select(F.col("merged").alias("vacancy_id")), "vacancy_id", "left_anti")


def delivered(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """(condition_id, vacancy_id, pass_id, delivered_at): the earliest delivery stays, with the pass it came in; of several
    merged vacancies the smallest pass is taken, of equal times the kept vacancy's."""
    m = F.col("was_merged")
    g = _moved(rows, moves).groupBy("condition_id", "vacancy_id").agg(F.min(F.when(m, F.col("pass_id"))).alias("p"), F.min(F.when(m, F.col("delivered_at"))).alias("t"), F.min(F.when(~m, F.col("pass_id"))).alias("own_p"), F.min(F.when(~m, F.col("delivered_at"))).alias("own_t"), F.bool_or(~m).alias("own"), F.bool_or(m).alias("new"))
    earlier = F.col("new") & (~F.col("own") | F.coalesce(F.col("t") < F.col("own_t"), F.lit(False)))
    return g.select("condition_id", "vacancy_id", F.when(earlier, F.col("p")).otherwise(F.col("own_p")).alias("pass_id"), F.least("t", "own_t").alias("delivered_at"))


def digest(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """(user_id, vacancy_id, mailed_at): the kept vacancy's mail stays, else the earliest of the merged ones."""
    m = F.col("was_merged")
    g = _moved(rows, moves).groupBy("user_id", "vacancy_id").agg(F.min(F.when(m, F.col("mailed_at"))).alias("t"), F.min(F.when(~m, F.col("mailed_at"))).alias("own_t"), F.bool_or(~m).alias("own"))
    return g.select("user_id", "vacancy_id", F.when(F.col("own"), F.col("own_t")).otherwise(F.col("t")).alias("mailed_at"))


def user_status(rows: DataFrame, moves: DataFrame) -> DataFrame:
    """(user_id, vacancy_id, status, changed_at): the status that is furthest on, of equal ones the latest."""
    rank = F.lit(1)
    for status, r in STATUS.items():
        rank = F.when(F.col("status") == status, r).otherwise(rank)
    order = F.struct(rank.alias("r"), "changed_at", "status")
    best = _moved(rows, moves).groupBy("user_id", "vacancy_id").agg(F.max(order).alias("b"))
    return best.select("user_id", "vacancy_id", F.col("b.status").alias("status"), F.col("b.changed_at").alias("changed_at"))


def _faces(postings: DataFrame) -> DataFrame:
    """Of postings what a vacancy's main one is chosen by and gives."""
    return postings.select("id", "vacancy_id", F.col("closed_at").isNotNull().alias("closed"), F.startswith("external_id", F.lit(PORTAL)).alias("portal"), "title", "url")


def main_posting(faces: DataFrame, of: DataFrame) -> DataFrame:
    """(id, title, url) of the vacancies of (id, vacancy_id), to which the postings of vacancy_id belong: from the first open posting that isn't
    the portal's, else its first. Faces are narrow before they are shuffled, and title and url go along only if they are read."""
    to = of.select("vacancy_id", F.col("id").alias("__of")).distinct()
    order = F.struct("closed", "portal", "id")
    return faces.join(to, "vacancy_id").groupBy(F.col("__of").alias("id")).agg(F.min_by("title", order).alias("title"), F.min_by("url", order).alias("url"))


def vacancies(rows: DataFrame, moves: DataFrame, postings: DataFrame) -> DataFrame:
    """Vacancies after a batch: merged ones go; kept ones take the earliest posted_at and first_seen_at, the latest
    last_confirmed_at, ACTIVE if a merged one is, are to be matched again (match_version null), and have title and url of their main
    posting (postings are those before the batch)."""
    gone = rows.join(moves.select(F.col("merged").alias("id"), "kept"), "id").groupBy("kept").agg(F.min("posted_at").alias("__posted"), F.min("first_seen_at").alias("__seen"), F.max("last_confirmed_at").alias("__confirmed"), F.bool_or(F.col("state") == "ACTIVE").alias("__active"))
    own = moves.select(F.col("kept").alias("id"), F.col("merged").alias("vacancy_id")).union(moves.select("kept", "kept"))
    main = main_posting(_faces(postings.where("closed_at IS NULL")), own).select(F.col("id").alias("__main"), F.col("title").alias("__title"), F.col("url").alias("__url"))
    k = rows.join(moves.select(F.col("merged").alias("id")), "id", "left_anti").join(gone, F.col("id") == F.col("kept"), "left").join(main, F.col("id") == F.col("__main"), "left")
    kept, found = F.col("kept").isNotNull(), F.col("__main").isNotNull()
    new = {
        "posted_at": F.least("posted_at", "__posted"), "first_seen_at": F.least("first_seen_at", "__seen"), "last_confirmed_at": F.greatest("last_confirmed_at", "__confirmed"),
        "state": F.when(F.col("__active"), "ACTIVE").otherwise(F.col("state")), "match_version": F.when(~kept, F.col("match_version")),
        "title": F.when(found, F.col("__title")).otherwise(F.col("title")), "url": F.when(found, F.col("__url")).otherwise(F.col("url")),
    }
    return k.select(*[(new[c].alias(c) if c in new else F.col(c)) for c in rows.columns])


RULES = {"job_posting": reassigned, "vacancy_revision": reassigned, "status_history": reassigned, "delivered": delivered, "digest": digest, "user_status": user_status, "position_match": dropped, "language": dropped}


def apply_batch(tables: dict[str, DataFrame], moves: DataFrame) -> dict[str, DataFrame]:
    """All tables after a batch of moves (merged, kept); a merged vacancy is nobody's keeper in its batch."""
    out = {name: RULES[name](rows, moves) if name in RULES else rows for name, rows in tables.items()}
    out["vacancy"] = vacancies(tables["vacancy"], moves, tables["job_posting"])
    return out


# journal


def _ids(moves: DataFrame) -> DataFrame:
    return moves.select(F.explode(F.array("merged", "kept")).alias("vacancy_id")).distinct()


def journal(tables: dict[str, DataFrame], moves: DataFrame) -> dict[str, DataFrame]:
    """What a batch is about to change: the moves themselves ("moves"), and by table the rows of merged and kept vacancies as they are.

    Images are rows, so a vacancy with very many children isn't gathered. They must be written before the batch is."""
    touched = _ids(moves)
    out = {name: rows.join(touched, "vacancy_id") for name, rows in tables.items() if name in CHILDREN}
    out = {name: rows.select(*tables[name].columns) for name, rows in out.items()}
    out["vacancy"] = tables["vacancy"].join(touched.withColumnRenamed("vacancy_id", "id"), "id").select(*tables["vacancy"].columns)
    return out | {"moves": moves}


def roll_back(tables: dict[str, DataFrame], kept: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables as they were before the batch of a journal; batches are rolled back in reverse order, the last one first."""
    touched = _ids(kept["moves"])
    out = {}
    for name, rows in tables.items():
        key = "id" if name == "vacancy" else "vacancy_id"
        if name in kept:
            rest = rows.join(touched.withColumnRenamed("vacancy_id", key), key, "left_anti")
            rows = rest.select(*rows.columns).unionByName(kept[name])
        out[name] = rows
    return out


def unmerge(tables: dict[str, DataFrame], kept: dict[str, DataFrame], wrong: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, blocked pairs (a, b)) after wrong (merged) moves of a journal are taken back, wherever the rows are by now.

    The merged vacancy, its postings and their revisions, its history, deliveries, mails and statuses return; what the kept one took over
    meanwhile stays with it, but title and url of both are those of their main posting and both are matched again. Moves
    that the journal doesn't hold are passed over. The pair is blocked from now on."""
    moves = kept["moves"].join(wrong.select("merged").distinct(), "merged").select("merged", "kept")
    back = moves.select(F.col("merged").alias("vacancy_id"))
    image = lambda name: kept[name].join(back, "vacancy_id").select(*tables[name].columns)

    def own_again(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
        return rows.join(ids.select(key, F.col("vacancy_id").alias("__own")), key, "left").withColumn("vacancy_id", F.coalesce("__own", "vacancy_id")).select(*rows.columns)

    out = dict(tables)
    postings = written(image("job_posting").select("id", "vacancy_id"))  # read by three joins
    out["job_posting"] = own_again(tables["job_posting"], postings, "id")
    if "vacancy_revision" in tables:
        out["vacancy_revision"] = own_again(tables["vacancy_revision"], postings.withColumnRenamed("id", "posting_id"), "posting_id")
    if "status_history" in tables:
        out["status_history"] = own_again(tables["status_history"], image("status_history").select("id", "vacancy_id"), "id")
    for name in ("delivered", "digest", "user_status"):
        if name in tables:
            absent = image(name).join(tables[name].select(*CHILDREN[name]), list(CHILDREN[name]), "left_anti")
            out[name] = tables[name].unionByName(absent.select(*tables[name].columns))
    all_ = tables["vacancy"].unionByName(kept["vacancy"].join(back.withColumnRenamed("vacancy_id", "id"), "id").join(tables["vacancy"].select("id"), "id", "left_anti").select(*tables["vacancy"].columns))
    both = moves.select(F.explode(F.array("merged", "kept")).alias("id")).distinct()
    main = main_posting(own_again(_faces(tables["job_posting"]), postings, "id"), both.select("id", F.col("id").alias("vacancy_id"))).select("id", F.col("title").alias("__title"), F.col("url").alias("__url"), F.lit(True).alias("__main"))
    found = F.col("__main").isNotNull()
    new = {"title": F.when(found, F.col("__title")).otherwise(F.col("title")), "url": F.when(found, F.col("__url")).otherwise(F.col("url")), "match_version": F.when(~found, F.col("match_version"))}
    out["vacancy"] = all_.join(main, "id", "left").select(*[(new[c].alias(c) if c in new else F.col(c)) for c in all_.columns])
    return out, moves.select(F.least("merged", "kept").alias("a"), F.greatest("merged", "kept").alias("b")).distinct()
