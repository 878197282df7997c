"""Table schemas and the small fixed dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_L, _I, _S, _D, _N = (
    T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.TimestampNTZType(),
)


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


RAW_TABLES: dict[str, T.StructType] = {
    "region": _schema(r_regionkey=_I, r_name=_S),
    "nation": _schema(n_nationkey=_I, n_name=_S, n_regionkey=_I),
    "customer": _schema(c_custkey=_L, c_name=_S, c_nationkey=_I, c_acctbal=_D, c_mktsegment=_S),
    "supplier": _schema(s_suppkey=_L, s_name=_S, s_nationkey=_I, s_acctbal=_D),
    "part": _schema(p_partkey=_L, p_name=_S, p_brand=_S, p_type=_S, p_size=_I, p_retailprice=_D),
    "orders": _schema(
        o_orderkey=_L, o_custkey=_L, o_orderstatus=_S, o_totalprice=_D, o_orderdate=_N,
        o_orderpriority=_S),
    "lineitem": _schema(
        l_orderkey=_L, l_partkey=_L, l_suppkey=_L, l_linenumber=_I, l_quantity=_D,
        l_extendedprice=_D, l_discount=_D, l_tax=_D, l_returnflag=_S, l_linestatus=_S,
        l_shipdate=_N),
    "events": _schema(event_id=_L, ts=_N, user_id=_L, event_type=_S, value=_D, props=_S),
    "documents": _schema(doc_id=_L, text=_S, lang=_S, source=_S, n_chars=_L),
    "embeddings": _schema(vec_id=_L, embedding=T.ArrayType(T.FloatType()), label=_I),
    "pages": _schema(page_id=_L, url=_S, html=_S),
    "benchmark": _schema(item_id=_L, text=_S),
    "labels": _schema(doc_id=_L, quality=_I, toxic=_I),
    "conversations": _schema(conv_id=_L, turn=_L, role=_S, text=_S),
}

# The eight assessment axes in catalog order.
AXES = (
    "work_location", "autonomy", "collaboration", "growth_direction",
    "work_change", "schedule_flexibility", "role_breadth", "customer_contact",
)
AXIS_CATALOG_VERSION = 1
CLOSE_DIFFERENCE = 25
MIN_COHORT = 10

# The 47 prefectures in the order of their official codes 01 to 47.
PREFECTURES = (
    "北海道 青森県 岩手県 宮城県 秋田県 山形県 福島県 茨城県 栃木県 群馬県 埼玉県 千葉県 "
    "東京都 神奈川県 新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 愛知県 三重県 "
    "滋賀県 京都府 大阪府 兵庫県 奈良県 和歌山県 鳥取県 島根県 岡山県 広島県 山口県 徳島県 "
    "香川県 愛媛県 高知県 福岡県 佐賀県 長崎県 熊本県 大分県 宮崎県 鹿児島県 沖縄県"
).split()


def axis_array():
    """The axes as one literal array, to be exploded without a join."""
    return F.array(*[
        F.struct(F.lit(i).alias("axis_idx"), F.lit(key).alias("axis_key"))
        for i, key in enumerate(AXES)
    ])


def prefecture_table(spark: SparkSession) -> DataFrame:
    """47 rows (prefecture_code, prefecture_name); a fixed-size broadcast side."""
    rows = [(f"{i:02d}", name) for i, name in enumerate(PREFECTURES, start=1)]
    return spark.createDataFrame(rows, "prefecture_code string, prefecture_name string")
