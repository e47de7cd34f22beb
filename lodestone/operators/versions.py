"""Versions and redaction: latest wins, compaction, removal, annotation, scrubbing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import redact
from ..sources import archives as A


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row for each key: a grouped maximum, so that a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row for each key."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])


def referenced_entries(entries: DataFrame, members: DataFrame) -> DataFrame:
    """Compaction: of each entry name the last, if the current manifest declares it or is it; in archive order."""
    last = latest(entries, ["archive", "name"], ["ordinal"])
    used = members.where("path is not null").select("archive", F.col("path").alias("name")).distinct()
    kept = last.join(used, ["archive", "name"], "left_semi")
    return kept.unionByName(last.where(F.col("name") == A.MANIFEST))


def remove_sections(sections: DataFrame, gone: DataFrame) -> DataFrame:
    """Sections without those that ``gone`` (archive, id) names; a job.spec can't be removed and stays."""
    named = sections.join(gone, ["archive", "id"], "left_semi").where("kind is null or kind <> 'job.spec'").select("archive", "section")
    return sections.join(named, ["archive", "section"], "left_anti")


def annotate(sections: DataFrame, notes: DataFrame, fields: tuple[str, ...] = ("structure_ref", "run_ref", "group", "label")) -> DataFrame:
    """Sections with the fields that ``notes`` (archive, id, fields...) sets; null leaves a field as it is."""
    own = [f for f in fields if f in notes.columns]
    new = notes.select("archive", "id", *[F.col(f).alias(f"_{f}") for f in own])
    rows = sections.join(new, ["archive", "id"], "left")
    for f in own:
        rows = rows.withColumn(f, F.coalesce(f"_{f}", f) if f in sections.columns else F.col(f"_{f}"))
    return rows.drop(*[f"_{f}" for f in own])


def conformer_view(atoms: DataFrame, alt_loc: str) -> DataFrame:
    """The atoms of one alternate location; a view, nothing is rewritten."""
    return atoms.where(F.col("alt_loc").isNull() | (F.col("alt_loc") == alt_loc))


def scrub_texts(members: DataFrame, patterns: list[str], replacement: str = "[redacted]") -> tuple[DataFrame, DataFrame]:
    """(members with run text redacted, report of changes and of what was passed over).

    Applies to the input, log and attachments of run.record sections that are UTF-8. The replacement is literal.
    """
    role = F.col("role")
    run = F.col("kind") == "run.record"
    scope = run & (role.isin("input", "log") | F.startswith(role, F.lit("attachment.")))
    text, counts = F.col("text"), []
    for p in patterns:
        text, n = redact(text, p, replacement)
        counts.append(n)
    total = reduce(lambda a, b: a + b, counts) if counts else F.lit(0)
    rows = members.withColumns({"matches": F.when(scope & F.col("text").isNotNull(), total), "scrubbed": F.when(scope & F.col("text").isNotNull(), text)})
    where = F.concat_ws("/", "section_id", "role")
    changes = rows.where("matches > 0").select("archive", where.alias("location"), F.lit("redact").alias("action"), F.col("matches").cast("long").alias("matches"))
    reason = F.when(F.lit(not patterns), F.lit("no pattern given")).when(scope & F.col("text").isNull(), F.lit("not UTF-8")).otherwise(F.lit("not a text of a run"))
    passed = rows.where(run & (F.lit(not patterns) | F.col("matches").isNull())).select("archive", where.alias("location"), F.concat(F.lit("skip: "), reason).alias("action"), F.lit(0).cast("long").alias("matches"))
    out = rows.withColumns({
        "text": F.coalesce("scrubbed", "text"),
        "content": F.when(F.col("matches") > 0, F.encode("scrubbed", "utf-8")).otherwise(F.col("content")),
    }).withColumns({"sha256": F.when(F.col("matches") > 0, F.sha2("content", 256)).otherwise(F.col("sha256")), "size": F.when(F.col("matches") > 0, F.octet_length("content").cast("long")).otherwise(F.col("size"))})
    return out.drop("matches", "scrubbed"), changes.union(passed)


def scrub_manifests(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(manifests without host name and authors' contacts, report)."""
    m = F.from_json("manifest", "map<string,string>")
    rows = manifests.where("manifest is not null").withColumn("m", m)
    provenance = F.from_json(rows["m"]["provenance"], "map<string,string>")
    authors = F.from_json(F.get_json_object("manifest", "$.metadata.authors"), "array<map<string,string>>")
    found = rows.select("archive", provenance.alias("p"), authors.alias("a"))
    host = found.where(F.map_contains_key("p", F.lit("hostname"))).select("archive", F.lit("/provenance/hostname").alias("location"), F.lit("remove").alias("action"))
    each = found.select("archive", F.posexplode("a").alias("k", "author")).withColumn("field", F.explode(F.array(F.lit("email"), F.lit("affiliation"))))
    contact = each.where(F.map_contains_key("author", F.col("field"))).select("archive", F.concat(F.lit("/metadata/authors/"), F.col("k"), F.lit("/"), "field"), F.lit("remove"))

    @F.pandas_udf("string")
    def strip(texts):
        import json

        def one(text):
            x = json.loads(text)
            if isinstance(x.get("provenance"), dict):
                x["provenance"].pop("hostname", None)
            for author in (x.get("metadata") or {}).get("authors", []):
                author.pop("email", None)
                author.pop("affiliation", None)
            return json.dumps(x, ensure_ascii=False)

        return texts.map(one)

    return manifests.withColumn("manifest", F.when(F.col("manifest").isNotNull(), strip("manifest"))), host.union(contact)


def job_status(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """(archive, id, status) of job sections by the runs that name them: pending without any, else failed, converged or running."""
    r = runs.select("archive", F.col("job_ref").alias("id"), F.col("status").alias("s"))
    counted = r.groupBy("archive", "id").agg(F.count_if(F.col("s") == "failed").alias("f"), F.count_if(F.col("s") == "converged").alias("c"), F.count("*").alias("n"))
    status = F.when(F.col("n").isNull(), "pending").when(F.col("c") > 0, "converged").when(F.col("f") > 0, "failed").otherwise("running")
    return jobs.join(counted, ["archive", "id"], "left").select("archive", "id", status.alias("status"))
