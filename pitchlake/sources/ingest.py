"""Landed feeds to typed tables: nested JSON events, schedules and lineups, CSV and Parquet; bad values become null."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = (
    "id long, matchId long, matchTimestamp string, minute int, second int, type struct<primary:string,secondary:array<string>>, location struct<x:string,y:string>, team struct<id:long,name:string>, "
    "opponentTeam struct<name:string>, player struct<id:long,name:string,position:string>, possession struct<id:long,eventIndex:long,duration:string,team:struct<name:string>,attack:struct<flank:string>>, "
    "pass struct<accurate:string,length:string,height:string,endLocation:struct<x:string,y:string>>, carry struct<endLocation:struct<x:string,y:string>>, shot struct<xg:string,isGoal:string,onTarget:string,postShotXg:string,goalkeeper:struct<id:long>>, "
    "groundDuel struct<duelType:string,keptPossession:string,recoveredPossession:string,stoppedProgress:string,takeOn:string,progressedWithBall:string>, aerialDuel struct<firstTouch:string>, infraction struct<type:string,yellowCard:string,redCard:string>"
)
SCHEDULE = "matches array<struct<matchId:long,seasonId:long,roundId:long,gameweek:int,status:string,dateutc:string,label:string,team1Id:long,team2Id:long,teamsData:map<string,struct<name:string,teamId:long>>,score1:double,score2:double>>"
LINEUPS = "matchId long, teamsData map<string,struct<formation:struct<lineup:array<struct<playerId:long>>,substitutions:array<struct<playerIn:long,playerOut:long,minute:int>>>>>"
_BOOLEAN = (
    "accurate", "isGoal", "onTarget", "keptPossession", "recoveredPossession", "stoppedProgress", "takeOn", "progressedWithBall", "firstTouch",
    "yellowCard", "redCard"
)
_NUMBER = ("x", "y", "length", "xg", "postShotXg", "duration")


def number(c: Column) -> Column:
    """A number, or null; a trailing s (seconds) is dropped, not-a-number is null."""
    x = F.replace(c, F.lit("s"), F.lit("")).try_cast("double")
    return F.when(~F.isnan(x), x)


def boolean(c: Column) -> Column:
    x = F.lower(F.trim(c))
    return F.when(x.isin("true", "1", "1.0"), True).when(x.isin("false", "0", "0.0"), False)


def flatten(schema: T.StructType, prefix: str = "") -> list[Column]:
    """A column for each leaf of nested structs, named by its path with _; arrays and maps stay whole."""
    out: list[Column] = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        if isinstance(f.dataType, T.StructType):
            out += flatten(f.dataType, path + ".")
        else:
            c = boolean(F.col(path)) if f.name in _BOOLEAN else number(F.col(path)) if f.name in _NUMBER else F.col(path)
            out.append(c.alias(path.replace(".", "_")))
    return out


def split_corrupt(raw: DataFrame, corrupt: str, column: str) -> tuple[DataFrame, DataFrame]:
    """Readable and corrupt records of `raw`. Spark refuses to read the corrupt ones alone, so a condition that always holds
    makes it read `column` as well, whatever else is asked for."""
    read = F.pmod(F.hash(column), F.lit(2)) < 2
    return raw.where(F.col(corrupt).isNull() & read), raw.where(F.col(corrupt).isNotNull() & read)


def read_events(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """One event a line; missing fields are null columns; a line of JSON that can't be read is no event (`feed.read_lines`
    returns those as well). `seq` orders the rows: file name, then place in the file.

    It is a struct, compared field by field: the file, where the split that a row was read from begins in it, and the
    place in that split. (Spark packs splits into partitions by size, so a row number alone would follow that.)"""
    if fmt == "json":
        raw = spark.read.schema(f"{EVENTS}, _corrupt string").options(mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt").json(path)
        raw, _ = split_corrupt(raw, "_corrupt", "id")
    else:
        raw = spark.read.schema(EVENTS).format(fmt).load(path)
    seq = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    return raw.select(seq.alias("seq"), *flatten(T.StructType([f for f in raw.schema if f.name != "_corrupt"])))


#: What the landed lists of other entities hold: the array's name, and its elements' fields.
ENTITIES = {
    "competitions": "wyId long, name string, format string, type string, category string, gender string",
    "teams": "wyId long, name string, officialName string, city string, type string, gender string",
    "players": "wyId long, shortName string, firstName string, lastName string, birthDate string, currentTeamId long, foot string",
    "seasons": "seasonId long, season struct<wyId:long,name:string,startDate:string,endDate:string,active:boolean,competitionId:long>",
}
SEASON = "wyId long, name string, competitionName string, competitionId long, startDate string, endDate string, active boolean"


def read_entities(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A landed response with a list of competitions, teams, players or seasons, a row each; those of teams without a name go."""
    x = spark.read.schema(f"{kind} array<struct<{', '.join(f.replace(' ', ':', 1) for f in ENTITIES[kind].split(', '))}>>").option("multiLine", True).json(path)
    rows = x.select(F.inline(kind))
    rows = rows.select(*flatten(rows.schema))
    return rows.where("name is not null") if kind == "teams" else rows


def accessible_seasons(spark: SparkSession, path: str) -> DataFrame:
    """Of landed season responses, a file each, those that name their competition; what isn't JSON counts as no season."""
    return spark.read.schema(SEASON).option("multiLine", True).option("mode", "PERMISSIVE").json(path).where(
        "competitionName is not null and competitionName <> ''"
    )


def missing_paths(spark: SparkSession, paths: Sequence[str]) -> list[str]:
    """Those of `paths` that are not there, in any store that Spark reads."""
    out = []
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            out.append(p)
    return out


def load_tables(spark: SparkSession, folder: str, names: Sequence[str], keep: bool = False) -> dict[str, DataFrame]:
    """Parquet tables of a folder; an error names all that are missing. With `keep` they stay in memory and on disk."""
    paths = {n: f"{folder}/{n}.parquet" for n in names}
    if gone := missing_paths(spark, list(paths.values())):
        raise FileNotFoundError("missing: " + ", ".join(gone))
    out = {n: spark.read.parquet(p) for n, p in paths.items()}
    return {n: df.persist(StorageLevel.MEMORY_AND_DISK) for n, df in out.items()} if keep else out


def inspect(tables: Mapping[str, DataFrame]) -> dict[str, tuple[list[tuple[str, str]], list]]:
    """Of each table the columns with their types, and the first row, if any."""
    return {n: (df.dtypes, df.head(1)) for n, df in tables.items()}


def read_schedule(spark: SparkSession, path: str, season: int | None = None, whole: bool = True) -> DataFrame:
    """Matches with names and score: the teams' data before the label for names, the label before the numbers for the score.
    A file is a document, or, with `whole` false, each of its lines is one."""
    x = spark.read.schema(SCHEDULE).option("multiLine", whole).json(path).select(F.inline("matches"))
    if season is not None:
        x = x.where(F.col("seasonId") == season)
    return parse_label(
        x.withColumns({f"data{i}": F.try_element_at("teamsData", F.col(f"team{i}Id").cast("string"))["name"] for i in (1, 2)})
    ).drop("teamsData", "data1", "data2").orderBy(F.col("date").asc_nulls_last(), "matchId")


def parse_label(x: DataFrame) -> DataFrame:
    """label "Home - Away, 4-0", data1, data2, score1, score2, dateutc → home, away, score, date."""
    parts = F.split("label", ",")
    teams = F.split(F.trim(F.get(parts, F.lit(0))), " - ")
    name = lambda i: F.when(F.size(teams) == 2, F.trim(F.get(teams, F.lit(i))))
    last = F.trim(F.get(parts, F.lit(1)))
    score = F.when((F.size(parts) == 2) & last.contains("-") & (F.length(last) >= 3), last)
    numbers = F.when(
        F.col("score1").isNotNull() & F.col("score2").isNotNull(),
        F.concat(F.col("score1").cast("int").cast("string"), F.lit(" - "), F.col("score2").cast("int").cast("string"))
    )
    return x.withColumns(
        {
            "home": F.coalesce("data1", name(0), F.lit("Unknown Home")), "away": F.coalesce("data2", name(1), F.lit("Unknown Away")),
            "score": F.coalesce(score, numbers, F.lit("? - ?")), "date": F.try_to_timestamp("dateutc", F.lit("yyyy-MM-dd HH:mm:ss"))
        }
    )


def read_lineups(spark: SparkSession, path: str) -> DataFrame:
    x = spark.read.schema(LINEUPS).json(path).select("matchId", F.explode("teamsData").alias("team", "data"))
    subs = F.transform(
        "data.formation.substitutions",
        lambda s: F.struct(s["playerIn"].alias("player_in"), s["playerOut"].alias("player_out"), s["minute"].alias("minute"))
    )
    return x.select(
        F.col("matchId").alias("match_id"), F.col("team").try_cast("long").alias("team_id"), F.col("data.formation.lineup.playerId").alias("lineup"),
        subs.alias("substitutions")
    )


def read_table(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    """What `write_table` wrote, with its schema."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    writer = df.write.mode("overwrite").partitionBy(*partition_by)
    (writer.option("header", True).csv if fmt == "csv" else writer.format(fmt).save)(path)
