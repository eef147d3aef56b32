"""JSON payloads: schemas with their older field names, readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Field names of the payloads and their older names.
DELTA = """contractVersion string, chapterIndex int, eventId string,
  items array<struct<fromCharacterId:string,toCharacterId:string,id1:string,id2:string,labels:array<string>,
    relation:array<string>,positivity:double,evidenceCount:int,count:int,reason:string>>,
  relations array<struct<fromCharacterId:string,toCharacterId:string,id1:string,id2:string,labels:array<string>,
    relation:array<string>,positivity:double,evidenceCount:int,count:int,reason:string>>,
  nodeWeights map<string,struct<weight:double,count:int>>, node_weights_accum map<string,struct<weight:double,count:int>>"""
EVENTS = """chapterIndex int, items array<struct<chapterIndex:int,eventId:string,event_id:string,start:int,end:int,
  startTxtOffset:int,endTxtOffset:int,text:string,eventText:string>>"""
ROSTER = """bookPrompt string, book_prompt string,
  items array<struct<characterId:string,id:string,commonName:string,common_name:string,names:array<string>,
    isMainCharacter:boolean,main_character:boolean,mainCharacter:boolean,descriptions:map<string,string>,
    description_ko:string,portraitPrompt:string,portrait_prompt:string>>,
  characters array<struct<characterId:string,id:string,commonName:string,common_name:string,names:array<string>,
    isMainCharacter:boolean,main_character:boolean,mainCharacter:boolean,descriptions:map<string,string>,
    description_ko:string,portraitPrompt:string,portrait_prompt:string>>"""
SUMMARIES = """chapterIndex int, language string,
  items array<struct<characterId:string,characterName:string,summary:string>>"""


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: (file, json). Payload files are small documents, read whole."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("json")
    )


def _parsed(uploads: DataFrame, schema: str, column: str = "json", skip_empty: bool = True) -> DataFrame:
    """Parse the payload column; a text that is no JSON object is flagged, not dropped.

    With ``skip_empty`` a file without a single character is left out, as an upload does.
    """
    p = F.from_json(column, f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    if skip_empty:
        # Said by the generator: as a filter it would move below the parsing and write every text twice.
        p = F.explode(F.when(F.length(column) > 0, F.array(p)))
    return (
        uploads.withColumn("_p", p)
        .withColumn("malformed", F.col("_p").isNull() | F.col("_p._corrupt_record").isNotNull())
    )


def parse_deltas(uploads: DataFrame) -> DataFrame:
    """(…, contract_version, chapter_idx, event_ref, items, node_weights) per upload file."""
    return _parsed(uploads, DELTA).select(
        *[c for c in uploads.columns if c != "json"],
        "malformed",
        F.col("_p.contractVersion").alias("contract_version"),
        F.col("_p.chapterIndex").alias("chapter_idx"),
        F.col("_p.eventId").alias("event_ref"),
        F.coalesce("_p.items", "_p.relations").alias("items"),
        F.coalesce("_p.nodeWeights", "_p.node_weights_accum").alias("node_weights"),
    )


def delta_item(i: Column) -> dict[str, Column]:
    """The fields of one delta item, with the older names folded in."""
    return {
        "from_raw": F.coalesce(i["fromCharacterId"], i["id1"]),
        "to_raw": F.coalesce(i["toCharacterId"], i["id2"]),
        "labels": F.coalesce(i["labels"], i["relation"]),
        "positivity": i["positivity"],
        "evidence_count": F.coalesce(i["evidenceCount"], i["count"]),
        "reason": i["reason"],
    }


def delta_weight(entry: Column) -> dict[str, Column]:
    """The fields of one entry of the node weights; ``missing`` marks a null value."""
    w = entry["value"]
    return {
        "character_raw": entry["key"],
        "missing": w.isNull(),
        "node_weight": F.when(w.isNotNull(), F.coalesce(w["weight"], F.lit(0.0))),
    }


def parse_events(uploads: DataFrame) -> DataFrame:
    """One row per event item; a file without items keeps one row with a null item."""
    keep = [c for c in uploads.columns if c != "json"]
    return (
        _parsed(uploads, EVENTS)
        .select(
            *keep, "malformed", F.col("_p.chapterIndex").alias("chapter_idx"),
            F.posexplode_outer("_p.items").alias("item_no", "i"),
        )
        .select(
            *keep,
            "malformed",
            "chapter_idx",
            "item_no",
            F.col("i.chapterIndex").alias("item_chapter_idx"),
            F.coalesce("i.eventId", "i.event_id").alias("event_raw"),
            F.coalesce("i.startTxtOffset", "i.start").alias("start_txt"),
            F.coalesce("i.endTxtOffset", "i.end").alias("end_txt"),
            F.coalesce("i.eventText", "i.text").alias("raw_text"),
        )
    )


def parse_roster(uploads: DataFrame) -> DataFrame:
    """One row per character item, plus the book prompt of its file."""
    keep = [c for c in uploads.columns if c != "json"]
    return (
        _parsed(uploads, ROSTER, skip_empty=False)
        .select(
            *keep, "malformed", F.coalesce("_p.bookPrompt", "_p.book_prompt").alias("book_prompt"),
            F.posexplode_outer(F.coalesce("_p.items", "_p.characters")).alias("item_no", "i"),
        )
        .select(
            *keep,
            "malformed",
            "book_prompt",
            "item_no",
            F.coalesce("i.characterId", "i.id").alias("character_raw"),
            F.coalesce("i.commonName", "i.common_name").alias("common_name"),
            F.col("i.names").alias("names"),
            F.coalesce("i.isMainCharacter", "i.main_character", "i.mainCharacter", F.lit(False)).alias("is_main"),
            F.col("i.descriptions").alias("descriptions"),
            F.col("i.description_ko").alias("description_ko"),
            F.coalesce("i.portraitPrompt", "i.portrait_prompt").alias("portrait_prompt"),
        )
    )


def parse_summaries(uploads: DataFrame) -> DataFrame:
    """One row per summary item; files in another language than ``ko`` are skipped.

    A file that names no chapter is kept whatever its language: that rule comes first.
    """
    keep = [c for c in uploads.columns if c != "json"]
    language = F.col("_p.language")
    return (
        _parsed(uploads, SUMMARIES)
        .filter(F.col("malformed") | F.col("_p.chapterIndex").isNull() | language.isNull() | (F.lower(language) == "ko"))
        .select(
            *keep, "malformed", F.col("_p.chapterIndex").alias("chapter_idx"),
            F.posexplode_outer("_p.items").alias("item_no", "i"),
        )
        .select(
            *keep,
            "malformed",
            "chapter_idx",
            "item_no",
            F.col("i.characterId").alias("character_raw"),
            F.col("i.summary").alias("summary_text"),
        )
    )


def graph_edge_json(edges: DataFrame) -> DataFrame:
    """Folded edges as response JSON, with the response's field names."""
    body = F.struct(
        F.col("left_id").alias("id1"),
        F.col("right_id").alias("id2"),
        "positivity",
        F.col("evidence_count").alias("count"),
        F.col("labels").alias("relation"),
        F.col("label_scores").alias("labelScores"),
        F.col("latest_labels").alias("latestLabels"),
        F.col("latest_reason").alias("latestReason"),
        F.col("latest_event_id").alias("latestEventId"),
        F.col("direction_counts").alias("directionCounts"),
    )
    return edges.select("book_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))


def delta_json(records: DataFrame) -> DataFrame:
    """Delta records as upload JSON."""
    items = F.transform(
        F.coalesce("items", F.array().cast(records.schema["items"].dataType)),
        lambda x: F.struct(
            x["from_id"].cast("string").alias("fromCharacterId"),
            x["to_id"].cast("string").alias("toCharacterId"),
            x["labels"].alias("labels"),
            x["positivity"].alias("positivity"),
            x["evidence_count"].alias("evidenceCount"),
            x["reason"].alias("reason"),
        ),
    )
    weights = F.transform_values("node_weights", lambda _, w: F.struct(w.alias("weight")))
    body = F.struct(
        F.col("contract_version").alias("contractVersion"),
        F.col("chapter_idx").alias("chapterIndex"),
        F.col("event_ref").alias("eventId"),
        items.alias("items"),
        weights.alias("nodeWeights"),
    )
    return records.select(
        "event_id", "book_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("json")
    )
