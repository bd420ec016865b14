"""Commands that rewrite tables: each returns the rows to merge or append, and the outcome of each item."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import ladder, stage_progress
from ..functions.money import amount_status
from ..operators.analytics import first_per_key
from ..operators.numbering import numbered


def promoted(staged: DataFrame, formal: DataFrame, key: str) -> DataFrame:
    """Staged rows to append to the formal table: those it lacks; a second run gives none."""
    return staged.join(formal.select(key), key, "left_anti")


def promoted_tree(notices: DataFrame, packages: DataFrame, requirements: DataFrame, formal: DataFrame, last: dict[str, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Formal (notices, packages, requirements) of staged notices that have none yet, each with an id of its own and its parent's.

    Staged rows: staging_id, parent_id (of notices the raw notice). formal: raw_id of formal notices that stand already: a second run, or a notice
    of the same raw notice, gives nothing. last: the last id given out for `notices`, `packages`, `requirements`; ids go on
    gapless by staging id.
    """
    new = first_per_key(notices, ["parent_id"], [F.col("staging_id")]).join(formal.select(F.col("raw_id").alias("parent_id")), "parent_id", "left_anti")

    def numbered_(rows: DataFrame, what: str) -> DataFrame:
        return numbered(rows, "id", last[what] + 1, [F.col("staging_id")])

    def under(rows: DataFrame, parents: DataFrame) -> DataFrame:
        ids = parents.select(F.col("staging_id").alias("parent_id"), F.col("id").alias("formal_parent_id"))
        return rows.join(ids, "parent_id")

    of_notices = numbered_(new, "notices").withColumn("formal_parent_id", F.col("parent_id"))
    of_packages = numbered_(under(packages, of_notices), "packages")
    return of_notices, of_packages, numbered_(under(requirements, of_packages), "requirements")


def amount_actions(candidates: DataFrame, actions: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, links) after marks of type, rejections and restorations; the last action of a candidate counts.

    candidates: id, link_id, amount_type, amount_value, status, reject_reason, confidence. actions: id, ordinal, action (MarkType, Reject, Restore), amount_type,
    reason. links: link_id, final_amount, final_source. A mark changes the type, and the status unless the candidate is selected; a rejection needs a reason, and of a
    selected candidate clears the link's final amount where that is its own; a restoration gives the status that type and value call for.
    """
    do = last_wins(actions, "id").select("id", "action", F.col("amount_type").alias("__type"), "reason").filter("action <> 'Reject' or trim(coalesce(reason, '')) <> ''")
    met = candidates.join(do, "id", "left")
    marked, refused, restored = (F.col("action") == a for a in ("MarkType", "Reject", "Restore"))
    kind = F.when(marked, F.col("__type")).otherwise(F.col("amount_type"))
    met = met.withColumn("__kind", kind).withColumn("__s", amount_status(F.col("__kind"), F.col("amount_value")))
    by_rule = restored | (marked & (F.col("status") != "Selected"))
    out = met.select(
        "id", "link_id", F.col("__kind").alias("amount_type"), "amount_value",
        F.when(refused, "Rejected").when(by_rule, F.col("__s.status")).otherwise(F.col("status")).alias("status"),
        F.when(refused, F.col("reason")).when(by_rule, F.nullif(F.col("__s.reason"), F.lit(""))).otherwise(F.col("reject_reason")).alias("reject_reason"),
        F.when(marked, F.greatest("confidence", F.col("__s.confidence"))).otherwise(F.col("confidence")).alias("confidence"),
    )
    gone = met.filter(refused & (F.col("status") == "Selected")).groupBy("link_id").agg(F.collect_set("amount_value").alias("__gone"))
    cleared = F.coalesce(F.array_contains("__gone", F.col("final_amount")), F.lit(False))
    after = links.join(gone, "link_id", "left").withColumns({"final_source": F.when(cleared, "Missing").otherwise(F.col("final_source")), "final_amount": F.when(~cleared, F.col("final_amount"))})
    return out, after.select(*links.columns)


def eligible(tasks: DataFrame, ids: DataFrame, key: str, most_high: int, risks: list[str]) -> DataFrame:
    """Pending tasks among the ids, of the allowed risks and with few high-risk issues, in the order in which the ids came (`ordinal`)."""
    first = ids.groupBy(key).agg(F.min("ordinal").alias("ordinal"))
    return tasks.join(first, key).filter((F.col("status") == "Pending") & F.col("risk").isin(risks) & (F.col("high_count") <= most_high)).orderBy("ordinal")


def moved(rows: DataFrame, ids: DataFrame, key: str, allowed: list[str], to: str) -> DataFrame:
    """key, outcome (Done, Missing, Skipped), status for every id: rows in an allowed status change to `to`."""
    state = rows.select(key, F.col("status").alias("was"), F.lit(True).alias("there"))
    outcome = ladder([(F.col("there").isNull(), "Missing"), (F.col("was").isin(allowed), "Done")], "Skipped")
    return ids.select(key).distinct().join(state, key, "left").select(key, outcome.alias("outcome"), F.when(F.col("was").isin(allowed), to).otherwise(F.col("was")).alias("status"))


def corrections(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """key, before_json, after_json of rows whose content differs."""
    pack = lambda df, name: df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias(name))
    return pack(before, "before_json").join(pack(after, "after_json"), key).filter("before_json <> after_json")


def appended(rows: DataFrame, new: DataFrame, group: list[str], number: str, order: list[Column]) -> DataFrame:
    """New rows numbered on from the greatest number of their group (from 1 in a new group)."""
    last = rows.groupBy(*group).agg(F.max(number).alias("__last"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return new.join(last, group, "left").withColumn(number, (F.coalesce("__last", F.lit(0)) + place).cast("int")).drop("__last")


def selected_amount(candidates: DataFrame, choices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates with their new status, links with amount and source): one selected per link, the one before demoted.

    candidates: id, link_id, status, amount_value, source; choices: link_id, id.
    """
    c = choices.select("link_id", F.col("id").alias("__chosen"))
    changed = candidates.join(c, "link_id").withColumn("status", F.when(F.col("id") == F.col("__chosen"), "Selected").when(F.col("status") == "Selected", "Recommended").otherwise(F.col("status")))
    links = changed.filter("id = __chosen").select("link_id", F.bround("amount_value", 2).alias("final_amount"), F.col("source").alias("final_source"))
    return changed.drop("__chosen"), links


def orphans_removed(candidates: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Candidates whose source record is still there, and those without one."""
    kept = candidates.filter(F.col(key).isNotNull()).join(records.select(key).distinct(), key, "left_semi")
    return kept.select(*candidates.columns).unionByName(candidates.filter(F.col(key).isNull()))


def propagated(links: DataFrame, sources: DataFrame, group: list[str], column: str) -> DataFrame:
    """Links whose `column` is empty get the one value that their group's sources agree on."""
    there = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != ""
    agreed = sources.filter(there(column)).groupBy(*group).agg(F.min(column).alias("__lo"), F.max(column).alias("__hi")).filter("__lo = __hi")
    empty = ~there(column)
    return links.join(agreed, group, "left").withColumn(column, F.when(empty & F.col("__lo").isNotNull(), F.col("__lo")).otherwise(F.col(column))).select(*links.columns)


def opened(opportunities: DataFrame, new: DataFrame, package: str = "package_id") -> DataFrame:
    """New opportunities of packages that have no active one; one per package."""
    active = opportunities.filter("status = 'Active'").select(package)
    return first_per_key(new, [package], [F.col("id")]).join(active, package, "left_anti").select(*new.columns)


def stage_changes(opportunities: DataFrame, wanted: DataFrame) -> DataFrame:
    """History rows id, from_stage, to_stage of opportunities whose stage really changes."""
    return opportunities.select("id", F.col("stage").alias("from_stage")).join(wanted.select("id", F.col("stage").alias("to_stage")), "id").filter("from_stage <> to_stage")


def job_actions(jobs: DataFrame, ids: DataFrame, retry: bool, force: bool = False) -> DataFrame:
    """id, outcome: Retried (a new row is to be queued), Cancelled, CancelRequested, Missing or Refused."""
    state = jobs.select("id", "status", F.lit(True).alias("there"))
    if retry:
        rules = [(F.col("there").isNull(), "Missing"), (F.col("status").isin("DeadLetter", "Cancelled", "Failed"), "Retried")]
    else:
        running = F.col("status") == "Running"
        rules = [(F.col("there").isNull(), "Missing"), ((F.col("status") == "Pending") | (running & F.lit(force)), "Cancelled"), (running, "CancelRequested")]
    return ids.select("id").distinct().join(state, "id", "left").select("id", ladder(rules, "Refused").alias("outcome"))


def retried(jobs: DataFrame, ids: DataFrame, as_of: Column, last_id: int, priority: int, default_attempts: int) -> DataFrame:
    """The rows to queue for jobs that may be retried by hand: a copy of each under a new id, pending now; history stays as it is.

    Copies keep type, queue, payload and business link, are named as retries, get a key of their own, at least `priority` and at least one attempt.
    """
    may = job_actions(jobs, ids, True).filter("outcome = 'Retried'").select("id")
    old = numbered(jobs.join(may, "id").withColumnRenamed("id", "original_id"), "id", last_id + 1, [F.col("original_id")])
    shown = F.when(F.trim(F.coalesce("job_name", F.lit(""))) == "", F.col("job_type")).otherwise(F.concat("job_name", F.lit(" (manual retry)")))
    tries = F.when(F.col("max_attempts") > 0, F.col("max_attempts")).otherwise(F.lit(default_attempts))
    key = F.when(F.col("deduplication_key").isNotNull(), F.concat_ws(":", "deduplication_key", F.lit("retry"), "original_id"))
    return old.withColumns(
        {"job_name": shown, "deduplication_key": key, "status": F.lit("Pending"), "priority": F.greatest("priority", F.lit(priority)), "available_at": as_of, "attempt_count": F.lit(0), "max_attempts": F.greatest(F.lit(1), tries)}
    )


# Names and kinds of keys under which jobs carry the id of their notice.
IN_JSON = r'(?<!\\)"(?:rawNoticeId|RawNoticeId)"\s*:\s*(?:"\s*)?\+?0*([1-9][0-9]{0,18})\s*(?:"|[,}\]])'
IN_TEXT = r"(?:^|\W)(?:rawNoticeId|RawNoticeId)\s*=\s*0*([1-9][0-9]{0,18})(?:$|\D)"
ID_AT_4, ID_AT_3 = ["attachment-process", "structured-parse"], ["outcome-supplier-extract", "review-outcome-ai-reparse", "manual-reparse", "approval-outcome-supplier-extract", "lifecycle-outcome-supplier-reparse"]


def notice_id_in_json(text: Column) -> Column:
    """The first positive notice id, at any depth, of a text that is JSON."""
    return F.when(F.try_parse_json(text).isNotNull(), F.nullif(F.regexp_extract(text, IN_JSON, 1), F.lit("")).try_cast("long"))


def notice_id_in_key(key: Column, module: str) -> Column:
    """The notice id that a module's deduplication key of a known kind holds: at the kind's place, else behind a part `raw`."""
    parts = F.filter(F.transform(F.split(F.coalesce(key, F.lit("")), ":"), lambda p: F.trim(p)), lambda p: p != "")
    number = lambda p: F.when(p.rlike("^[0-9]{1,19}$"), p.try_cast("long"))
    positive = lambda n: F.when(n > 0, n)
    part = lambda i: positive(number(F.get(parts, F.lit(i))))
    kind = F.lower(F.get(parts, F.lit(1)))
    behind = F.transform(parts, lambda p, i: F.when((i >= 2) & (F.lower(p) == "raw"), positive(number(F.get(parts, i + 1)))))
    return F.when(F.lower(F.get(parts, F.lit(0))) == module.lower(), F.coalesce(F.when(kind.isin(ID_AT_4), part(4)), F.when(kind.isin(ID_AT_3), part(3)), F.get(F.filter(behind, lambda n: n.isNotNull()), F.lit(0))))


def inferred_links(jobs: DataFrame, module: str, business_type: str = "RawNotice") -> DataFrame:
    """jobs of a module with source_module, business_type, business_id and correlation_id filled in from queue and type, payload, key and result, where they lack them.

    jobs: job_type, queue, payload, result, deduplication_key and the four. An id counts from what stands there, the payload's JSON, the key, the result's JSON, an assignment in the result, in that order.
    """
    own = (F.lower("queue") == module.lower()) | F.startswith(F.lower("job_type"), F.lit(module.lower() + "."))
    filled = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    rows = jobs.withColumns({"source_module": F.coalesce(filled("source_module"), F.when(own, F.lit(module))), "business_type": filled("business_type"), "correlation_id": filled("correlation_id"), "business_id": F.when(F.col("business_id") > 0, F.col("business_id"))})
    told = F.nullif(F.regexp_extract(F.coalesce("result", F.lit("")), IN_TEXT, 1), F.lit("")).try_cast("long")
    found = F.coalesce("business_id", notice_id_in_json(F.col("payload")), notice_id_in_key(F.col("deduplication_key"), module), notice_id_in_json(F.col("result")), told)
    rows = rows.withColumn("__id", F.when(F.lower("source_module") == module.lower(), found))
    known = F.col("__id").isNotNull()
    return rows.withColumns(
        {"business_type": F.when(known, F.coalesce("business_type", F.lit(business_type))).otherwise(F.col("business_type")), "correlation_id": F.when(known, F.coalesce("correlation_id", F.col("__id").cast("string"))).otherwise(F.col("correlation_id")), "business_id": F.coalesce("__id", "business_id")}
    ).drop("__id")


def backfill_batch(jobs: DataFrame, module: str, after_id: int, size: int) -> tuple[DataFrame, int | None]:
    """(rows of the next batch by id that the inference changes, the id to go on behind; None at the end): a run that broke off goes on there."""
    batch = jobs.filter(F.col("id") > after_id).orderBy("id").limit(size)
    last = batch.agg(F.max("id")).first()[0]
    links = ["source_module", "business_type", "business_id", "correlation_id"]
    before = batch.select("id", F.struct(*links).alias("__was"))
    changed = inferred_links(batch, module).join(before, "id").filter(~F.struct(*links).eqNullSafe(F.col("__was"))).drop("__was")
    return changed, last


def business_links(jobs: DataFrame, paths: dict[str, str]) -> DataFrame:
    """jobs with business_type and business_id from the first payload path that has a value, where they lack one."""
    found = F.coalesce(*[F.when(F.get_json_object("payload", p).isNotNull(), F.struct(F.lit(t).alias("t"), F.get_json_object("payload", p).alias("i"))) for t, p in paths.items()])
    return jobs.withColumn("__f", found).withColumns({"business_type": F.coalesce("business_type", "__f.t"), "business_id": F.coalesce("business_id", F.col("__f.i").try_cast("long"))}).drop("__f")


def effective_permissions(users: DataFrame, roles: DataFrame, grants: DataFrame, entitled: DataFrame) -> DataFrame:
    """user_id, permission: role grants within the tenant's entitlements, and `self`; administrators have all entitlements.

    users: user_id, tenant_id, is_admin; roles: user_id, role_id; grants: role_id, permission; entitled: tenant_id, permission.
    """
    of_role = users.join(roles, "user_id").join(grants, "role_id").join(entitled, ["tenant_id", "permission"], "left_semi").select("user_id", "permission")
    admins = users.filter("is_admin").join(entitled, "tenant_id").select("user_id", "permission")
    return of_role.union(admins).union(users.select("user_id", F.lit("self"))).distinct()


def last_wins(commands: DataFrame, key: str) -> DataFrame:
    """The last command of each key, by `ordinal`."""
    return first_per_key(commands, [key], [F.desc("ordinal")])


def pursued(rows: DataFrame, wanted: DataFrame, steps: dict[str, int], closed: str = "Closed") -> DataFrame:
    """Pursuits after a load of wanted stages (id, stage): new ids are created, known ones move; status and progress follow the stage."""
    now = rows.select("id", F.col("stage").alias("__was")).join(wanted.select("id", F.col("stage").alias("__to")), "id", "full")
    stage = F.coalesce("__to", "__was")
    outcome = ladder([(F.col("__was").isNull(), "Created"), (F.col("__to").isNotNull() & (F.col("__to") != F.col("__was")), "Updated")], "Unchanged")
    return now.select("id", stage.alias("stage"), F.when(stage == closed, closed).otherwise("Active").alias("status"), stage_progress(stage, steps).alias("progress"), outcome.alias("outcome"))


def renumbered(rows: DataFrame, changes: DataFrame, deleted: DataFrame, key: str, required: str) -> tuple[DataFrame, DataFrame]:
    """(rows after manual updates and deletes, refused changes): a change without its required value or without its row is refused."""
    known = changes.join(rows.select(key), key, "left_semi")
    good = known.filter(F.trim(F.coalesce(required, F.lit(""))) != "")
    refused = changes.join(good.select(key), key, "left_anti")
    kept = rows.join(deleted.select(key), key, "left_anti")
    return kept.join(good.select(key), key, "left_anti").unionByName(good.join(kept.select(key), key, "left_semi").select(*rows.columns)), refused
