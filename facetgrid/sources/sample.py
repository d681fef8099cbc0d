"""A synthetic catalogue: structure by the row number, only names by a seeded hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from facetgrid.functions.text import DIGITS, FULL_DIGITS, WEEKDAYS

# Labels that rows cycle through, and names that the seed picks.
TERMS = ("1学期", "2学期", "通年", "1学期前半", "2学期後半")
CAMPUSES = ("朝倉キャンパス", "物部キャンパス", "岡豊キャンパス", "")
KINDS = ("講義", "演習", "実習", "実験", "実技")
DEPARTMENTS = ("人文社会科学部", "教育学部", "理工学部", "医学部", "農林海洋科学部", "共通教育")
TOPICS = ("微分積分学", "線形代数", "有機化学", "海洋生物学", "経済学", "日本文学", "情報処理", "地域医療")
FAMILY, GIVEN = ("佐藤", "鈴木", "高橋", "田中", "伊藤", "渡辺"), ("一郎", "花子", "健", "桂", "実")
KEYWORDS = ("統計", "極限", "生態系", "古典", "アルゴリズム", "看護")
MODES = (("onsite", "対面"), ("online", "オンライン"), ("ondemand", "オンデマンド"), ("hybrid", "対面とオンライン"), ("unknown", "未定"))
ITEMS = ("期末試験", "中間レポート", "小テスト", "小レポート", "学習意欲・授業参加度", "その他")


def _cycle(values: tuple[str, ...], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))


def _pick(values: tuple[str, ...], i: Column, seed: int, salt: str) -> Column:
    return _cycle(values, F.pmod(F.xxhash64(i, F.lit(seed), F.lit(salt)), F.lit(len(values))))


def timetable(i: Column) -> Column:
    wide = F.translate((i % 6 + 1).cast("string"), DIGITS, FULL_DIGITS)
    meeting = lambda day, period: F.concat(_cycle(TERMS, i), F.lit(": "), day, F.lit("曜日"), period, F.lit("時限"))
    one = meeting(_cycle(tuple(WEEKDAYS[:6]), i), wide)
    two = meeting(_cycle(tuple(WEEKDAYS[:6]), i + 2), F.translate(((i + 1) % 6 + 1).cast("string"), DIGITS, FULL_DIGITS))
    none = F.concat(_cycle(TERMS, i), F.lit(": 集中講義"))
    return F.when(i % 9 == 8, none).when(i % 7 == 3, F.concat(one, F.lit(", "), two)).otherwise(one)


def courses(spark: SparkSession, n: int = 3000, seed: int = 42) -> DataFrame:
    """(file_ord, item, raw fields...) of ``n`` courses."""
    i = F.col("id")
    rows = spark.range(n)
    topic = _pick(TOPICS, i, seed, "topic")
    person = F.concat(_pick(FAMILY, i, seed, "family"), F.lit(" "), _pick(GIVEN, i, seed, "given"))
    return rows.select(
        F.lit(0).alias("file_ord"), i.cast("int").alias("item"), F.format_string("%05d", i + 1).alias("kogiCd"),
        F.when(i == 3, F.concat(topic, F.lit(" <b>&\"'"))).otherwise(topic).alias("kogiNm"),
        F.when(i == 7, "").otherwise(person).alias("tantoKyoin"), timetable(i).alias("jikanwari"), _cycle(TERMS, i).alias("kogiKaikojikiNm"),
        _cycle(KINDS, i).alias("kogiKubunNm"), F.when(i == 7, "").otherwise(_cycle(DEPARTMENTS, i)).alias("sekininBushoNm"), _cycle(CAMPUSES, i).alias("kochiNm"),
        topic.alias("gakusokuKamokuNm"), F.when(i % 5 == 2, F.concat(topic, F.lit("入門"))).alias("fukudai"),
        F.lit(None).cast("string").alias("taishoGakka"), F.concat((i % 4 + 1).cast("string"), F.lit("年")).alias("taishoNenji"),
        F.when(i % 3 > 0, "専門").alias("kamokuBunrui"), F.lit(None).cast("string").alias("kamokuBunya"), F.lit("4").alias("syllabusKomokuPatternId"),
        F.lit("2026").alias("kaikoNendo"), F.format_string("202601%011d", i).alias("lastUpdate"),
    )


def details(spark: SparkSession, n: int = 3000, seed: int = 42) -> DataFrame:
    """Detail records of seven in ten courses."""
    i = F.col("id")
    sessions = F.when(i % 10 < 5, F.lit(15)).otherwise((i % 6 + 3)).cast("int")
    plan = F.transform(F.sequence(F.lit(1), sessions), lambda k: F.struct(k.cast("bigint").alias("n"), F.when(k == 1, "ガイダンス").when(k == sessions, "まとめ").otherwise(F.concat(F.lit("第"), k.cast("string"), F.lit("課"))).alias("text"), F.lit(None).cast("string").alias("kind")))
    item = lambda k: F.struct(_cycle(ITEMS, i + k).alias("item"), F.when(i % 6 == 5, None).otherwise(F.lit(50)).cast("bigint").alias("weight"), F.lit("other").alias("type"))
    mode = lambda k: _cycle(tuple(m[k] for m in MODES), i)
    return spark.range(n).where(i % 10 < 7).select(
        F.format_string("%05d", i + 1).alias("cd"), F.format_string("202601%011d", i).alias("lastUpdate"), (i % 4 + 1).cast("double").cast("string").alias("unit"),
        F.struct(mode(0).alias("mode"), mode(1).alias("raw"), F.lit(False).alias("isMedia")).alias("delivery"),
        F.struct(F.array(item(0), item(1)).alias("rows"), F.lit(None).cast("string").alias("note")).alias("eval"), plan.alias("plan"),
        F.transform(F.sequence(F.lit(1), (i % 3 + 3).cast("int")), lambda k: F.concat(F.lit("目標"), k.cast("string"))).alias("goals"),
        F.array(_pick(KEYWORDS, i, seed, "a"), _pick(KEYWORDS, i, seed, "b")).alias("keywords"),
    )
