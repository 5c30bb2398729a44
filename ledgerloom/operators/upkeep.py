"""Table maintenance: rebuild or upsert, notes, queues, last-good data, de-duplication, logs and recurring rules."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.functions.titles import slugify
from ledgerloom.session import materialize
from ledgerloom.sources.versions import VersionedTable

SOURCES = ("ics", "csv", "recurring")
MAX_FEED_BYTES = 8 * 1024 * 1024


# ------------------------------------------------------------------ calendar sources

def rebuild_or_upsert(existing: DataFrame, parsed: DataFrame) -> DataFrame:
    """The events table after an import.

    parsed (pos, id, source, …, error). A source whose inputs are all free of errors is replaced; otherwise its
    good rows are put over the existing ones, which stay. Of several rows with one id the last one counts.
    """
    cols = [c for c in existing.columns if c not in ("id", "source")]
    good = parsed.where("error IS NULL").groupBy("id", "source").agg(
        F.max(F.struct("pos", *cols)).alias("r")
    ).select("id", *[F.col(f"r.{c}").alias(c) for c in cols], "source")
    # Sources are a handful of names: a set of them filters the stored table where it is read.
    broken = parsed.where("error IS NOT NULL").agg(F.collect_set("source"))
    kept = existing.where(F.array_contains(broken.scalar(), F.col("source"))).join(good.select("id"), "id", "left_anti")
    return good.unionByName(kept)


def save_sources(events: DataFrame, path: str) -> DataFrame:
    """Write the whole events table by source to a new folder and read it back.

    The result of an import reads the table it replaces, so it never goes over that table in place.
    """
    events.write.mode("errorifexists").partitionBy("source").parquet(path)
    return events.sparkSession.read.schema(events.schema).parquet(path)


def commit_import(table: VersionedTable, parsed: DataFrame, batch: int) -> bool:
    """Import number ``batch`` into a table partitioned by ``source``; False if it is there already.

    A clean source is replaced, also by nothing; a broken one gets its good rows put over the old ones, and one without any
    good row keeps its files as they are.
    """
    rows = materialize(parsed, "parsed")
    state = {r.source: r for r in rows.groupBy("source").agg(F.expr("bool_or(error IS NOT NULL) AS broken"), F.expr("bool_or(error IS NULL) AS good")).collect()}
    sources = {s for (s,) in table.owners()} | set(state)
    replaced = [s for s in sources if s not in state or not state[s].broken or state[s].good]
    after = rebuild_or_upsert(table.read(), rows)
    return table.commit(batch, after.where(F.col("source").isin(replaced)), [(s,) for s in replaced])


def collapse_report(parsed: DataFrame) -> DataFrame:
    """Per source: rows parsed, distinct ids stored, and how many collapsed."""
    per_id = parsed.groupBy("source", "id").agg(F.count("*").alias("n"))
    return per_id.groupBy("source").agg(F.sum("n").alias("parsed"), F.count("*").alias("stored")).withColumn(
        "collapsed", F.expr("parsed - stored")
    )


def expand_recurring(rules: DataFrame, breaks: DataFrame, term_start: str, term_end: str) -> DataFrame:
    """Class meetings: every day of the term on a rule's weekdays, outside the breaks.

    rules (rule_id, course, title, weekdays, start_time, end_time), breaks (start, end).
    """
    off = breaks.selectExpr("explode(sequence(start, end)) AS date").distinct()
    days = rules.selectExpr("*", f"explode(sequence(date'{term_start}', date'{term_end}')) AS date").where(
        "array_contains(weekdays, weekday(date))"
    )
    return days.join(off, "date", "left_anti").selectExpr(
        "rule_id", "course", "title",
        "cast(concat(date, ' ', start_time) AS timestamp_ntz) AS starts_at",
        "cast(concat(date, ' ', end_time) AS timestamp_ntz) AS ends_at",
    )


#: Bytes of codes that one automaton is built of; its nodes take some thirty times as much.
AUTOMATON_BYTES = 4 * 1024 * 1024


def match_course(texts: DataFrame, codes: DataFrame, limit: int = AUTOMATON_BYTES) -> DataFrame:
    """The course whose code a text contains, longest code first, else 'OTHER'. texts (id, text), codes (code).

    All codes are looked for in one pass over a text by an automaton that is built on the driver and broadcast. Codes of more
    than ``limit`` bytes are dealt out by hash to several automata, one pass over the texts for each; a text carries its best
    code from one pass to the next, so nothing is shuffled and no row is made but one per text. A null text matches nothing,
    a code without letters or digits every other text.
    """
    flat = lambda c: f"upper(regexp_replace({c}, '(?U)[\\\\s_-]+', ''))"
    wanted = materialize(codes.where("code IS NOT NULL").groupBy(F.expr(f"{flat('code')} AS piece")).agg(F.min("code").alias("code")), "codes")
    size = wanted.agg(F.expr("sum(octet_length(piece) + octet_length(code))")).first()[0] or 0
    shards = max(1, -(-size // limit))
    found = texts.select("id", F.expr(f"{flat('text')} AS flat"), F.lit(None).cast("string").alias("piece"), F.lit(None).cast("string").alias("code"))
    for shard in range(shards):
        here = wanted.where(f"pmod(xxhash64(piece), {shards}) = {shard}").collect()
        found = found.mapInArrow(_best_codes(found.sparkSession, {r.piece: r.code for r in here}), found.schema)
        if shard + 1 < shards:
            found = materialize(found, "matched")
    return found.select("id", F.expr("coalesce(code, 'OTHER') AS course"))


def _best_codes(spark: SparkSession, codes: dict[str, str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over (id, flat, piece, code) that puts in the longest code found, the first by name of several."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for piece, code in codes.items():
        if piece:
            automaton.add_word(piece, (-len(piece), code, piece))
    automaton.make_automaton()
    shared = spark.sparkContext.broadcast((automaton, codes.get("")))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, anywhere = shared.value
        for batch in batches:
            best = []
            for text, piece, code in zip(*(batch[c].to_pylist() for c in ("flat", "piece", "code")), strict=True):
                hits = [] if code is None else [(-len(piece), code, piece)]
                if text is not None and anywhere is not None:
                    hits.append((0, anywhere, ""))
                if text and len(finder):
                    hits.extend(hit for _, hit in finder.iter(text))
                best.append(min(hits)[1:] if hits else (None, None))
            columns = [pa.array([b[i] for b in best], pa.string()) for i in (1, 0)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["flat"], *columns], schema=batch.schema)

    return search


def feed_last_good(fetches: DataFrame) -> DataFrame:
    """Per feed the newest acceptable body, and whether a later fetch failed.

    fetches (feed, fetched_at, body): a body counts when it is an iCalendar document of at most 8 MB.
    """
    ok = f"body IS NOT NULL AND octet_length(body) <= {MAX_FEED_BYTES} AND startswith(upper(ltrim(left(body, 400))), 'BEGIN:VCALENDAR')"
    return fetches.groupBy("feed").agg(
        F.expr(f"max_by(body, fetched_at) FILTER (WHERE {ok}) AS body"),
        F.expr(f"max(fetched_at) FILTER (WHERE {ok}) AS good_at"),
        F.max("fetched_at").alias("checked_at"),
    ).withColumn("stale", F.expr("body IS NULL OR good_at < checked_at"))


# ------------------------------------------------------------------ notes and links

def note_paths(notes: DataFrame) -> DataFrame:
    """File path of each note (id, course, name, …); a later note with the same slug gets the last part of its id appended."""
    slugged = notes.withColumn("slug", F.expr(slugify("name")))
    first = slugged.groupBy("course", "slug").agg(F.min("id").alias("first_id"))
    return slugged.join(first, ["course", "slug"]).withColumn(
        # Fixed value: where notes are kept.
        "path", F.expr("concat(course, '/_synced/quizzes/', slug, if(id = first_id, '', concat('-', substring_index(cast(id AS string), '-', -1))), '.md')")
    ).drop("first_id")


def quiz_notes(bodies: DataFrame, site: str) -> DataFrame:
    """Markdown of quizzes that carry text, from (id, course, name, due, attempts, body)."""
    facts = "concat_ws(' - ', if(due = '', null, concat('due ', due)), nullif(attempts, ''))"
    return bodies.where("body <> ''").selectExpr(
        "id", "course", "name",
        f"concat('# ', name, '\n\n> Quiz on {site} for ', course, if({facts} = '', '', concat(' (', {facts}, ')')), '.\n\n', body, '\n') AS text",
    )


def note_status(notes: DataFrame, current: DataFrame) -> DataFrame:
    """new, updated or unchanged per note, by comparing its text with the file already there (path, text)."""
    old = current.select("path", F.col("text").alias("old_text"), F.lit(True).alias("found"))
    return note_paths(notes).join(old, "path", "left").selectExpr(
        "id", "course", "path",
        "CASE WHEN found IS NULL THEN 'new' WHEN old_text <=> text THEN 'unchanged' ELSE 'updated' END AS status",
    )


def pending_links(links: DataFrame, imported: DataFrame) -> DataFrame:
    """Links that need a signed-in browser and are not imported yet. links (…, url, session), imported (url)."""
    gated = links.where("session IN ('google', 'sharepoint')")
    return gated.join(imported.select("url"), "url", "left_anti").withColumn("link_id", F.expr(X.link_id("url")))


def scan_candidates(pages: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Pages that only wrap a local image and have no transcript at least as new.

    pages (path, html, mtime), transcripts (path, mtime).
    """
    words = f"size(filter(split({X.strip('''regexp_replace(html, '<[^>]+>', ' ')''')}, '(?U)\\\\s+'), w -> w <> ''))"
    src = "regexp_extract(html, '(?i)<img[^>]+src=[\"\\']([^\"\\']+)[\"\\']', 1)"
    found = pages.where(f"{words} <= 30 AND {src} <> '' AND NOT rlike({src}, '^(http:|https:|data:)')").withColumn("image", F.expr(src))
    done = transcripts.select("path", F.col("mtime").alias("done_at"))
    return found.join(done, "path", "left").where("done_at IS NULL OR done_at < mtime").select("path", "image")


def scanned_documents(stats: DataFrame) -> DataFrame:
    """Documents that are pictures of text: hardly any characters, at least one image. stats (chars, images, pages)."""
    return stats.where("chars < 100 AND images > 0 AND pages > 0")


# ------------------------------------------------------------------ last-good data and de-duplication

def keep_last_good(fresh: DataFrame, previous: DataFrame, errors: DataFrame) -> DataFrame:
    """Fresh rows per tenant; a tenant whose pull failed outright keeps its previous rows, marked stale."""
    failed = errors.select("tenant").distinct().join(fresh.select("tenant"), "tenant", "left_anti")
    held = previous.join(failed, "tenant", "left_semi")
    return fresh.withColumn("stale", F.lit(False)).unionByName(held.withColumn("stale", F.lit(True)))


def unseen(items: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return items.join(seen.select(*keys), keys, "left_anti")


def override_union(bundled: DataFrame, own: DataFrame) -> DataFrame:
    """Bundled rows with a user's own rows over them, by name without regard to case. Rows (pos, name, …)."""
    both = bundled.withColumn("priority", F.lit(0)).unionByName(own.withColumn("priority", F.lit(1)))
    cols = [c for c in bundled.columns if c != "pos"]
    return both.groupBy(F.expr("lower(name) AS name_key")).agg(F.max(F.struct("priority", "pos", *cols)).alias("r")).select(
        *[f"r.{c}" for c in cols], F.expr("r.priority = 1 AS own")
    )


def feed_dedup(events: DataFrame) -> DataFrame:
    """One row per happening: same start and same letters and digits in the title; the first feed wins.

    events (feed_rank, pos, title, starts_at).
    """
    return events.groupBy("starts_at", F.expr("regexp_replace(lower(title), '[^a-z0-9]+', '') AS slug")).agg(
        F.expr("min(struct(feed_rank, pos, title)) AS r")
    ).select("starts_at", "r.title", "r.feed_rank", "r.pos")


def notified_prune(seen: DataFrame, today: str, keep_days: int = 120, max_keys: int = 2000) -> DataFrame:
    """Notification keys of the last ``keep_days``, the newest ``max_keys`` of them. seen (key, day)."""
    return seen.where(f"day >= date_sub(date'{today}', {keep_days})").orderBy(F.desc("day"), "key").limit(max_keys)


# ------------------------------------------------------------------ run reports

def sync_status(sites: DataFrame) -> DataFrame:
    """Per run: sites, new and moved items, and ok unless every site failed. sites (run_id, site, ok, new, moved)."""
    return sites.groupBy("run_id").agg(
        F.count("*").alias("sites"),
        F.expr("bool_or(ok) AS ok"),
        F.expr("count_if(NOT ok) AS failed_sites"),
        F.expr("coalesce(sum(new) FILTER (WHERE ok), 0) AS total_new"),
        F.expr("coalesce(sum(moved) FILTER (WHERE ok), 0) AS total_moved"),
    )


def error_kind(line: str) -> str:
    """SQL text: the exception name in a log line, never its message."""
    # Fixed value: what the name of an exception looks like.
    name = f"regexp_extract({line}, '\\\\b([A-Z][A-Za-z0-9_]{{0,38}}(?:Error|Exception|Warning))\\\\b', 1)"
    known = ["AssistBlocked", "BackendUnavailable", "IndexBusy", "LoginRequired", "NoRelevantResults", "StoreOutOfSync"]
    named = " ".join(f"WHEN contains({line}, '{k}') THEN '{k}'" for k in known)
    return f"CASE WHEN {name} <> '' THEN {name} {named} WHEN contains({line}, 'Traceback') THEN 'Traceback' ELSE 'an error (see the log)' END"


def error_kinds(log: DataFrame, tail: int = 400) -> DataFrame:
    """Error kinds among the last ``tail`` lines of each source. log (source, line_no, line)."""
    w = Window.partitionBy("source").orderBy(F.desc("line_no"))
    recent = log.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= tail)
    bad = recent.where("contains(line, 'Traceback') OR contains(line, 'ERROR') OR contains(line, 'Exception')")
    return bad.groupBy("source", F.expr(f"{error_kind('line')} AS kind")).agg(
        F.count("*").alias("n"), F.max("line_no").alias("last_line")
    )
