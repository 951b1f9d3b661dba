"""Row shapes. `slug` + `run_ts` identify one run of one product; `source_order` and `pos` are its input position:
which source came first, then the place within the source. Together they are an offer's identity in its run."""

from pyspark.sql import DataFrame, functions as F, types as T

OFFER_FIELDS = [
    ("slug", "string"), ("run_ts", "timestamp"), ("source_order", "int"), ("pos", "bigint"),
    ("source", "string"), ("url", "string"), ("title", "string"), ("fetched_at", "timestamp"),
    ("brand", "string"), ("mpn", "string"), ("attrs", "map<string,string>"), ("condition", "string"),
    ("is_kit", "boolean"), ("kit_module_count", "int"), ("unit_price_usd", "double"), ("kit_price_usd", "double"),
    ("quantity_available", "int"), ("seller_name", "string"), ("seller_rating_pct", "double"),
    ("seller_feedback_count", "int"), ("ship_from_country", "string"), ("qvl_status", "string"),
    ("flags", "array<string>"), ("total_for_target_usd", "double"), ("buy_url", "string"), ("image_url", "string"),
    ("rating", "double"), ("rating_count", "int"),
]
OFFER_DDL = ", ".join(f"`{n}` {t}" for n, t in OFFER_FIELDS)
OFFER_COLUMNS = [n for n, _ in OFFER_FIELDS]
PLACE = ["source_order", "pos"]


PROFILE_DDL = """
schema_version int, slug string, display_name string, description string, product_type string,
target struct<unit:string,amount:int,configurations:array<struct<module_count:int,module_capacity_gb:int>>>,
queries array<string>,
match struct<aliases:array<string>,title_excludes:array<string>,variant_strict:boolean>,
filters struct<condition_in:array<string>,in_stock:boolean,min_quantity:int>,
flags array<string>,
sources struct<serper:struct<enabled:boolean,gl:string,num:int>,ebay:struct<enabled:boolean>,amazon:struct<enabled:boolean,depth:int,priority:string>>,
vendor_allowlist array<string>, vendor_blocklist array<string>,
display struct<max_listings:int,per_vendor_cap:int,attrs:array<string>>,
schedule struct<cron:string,run_at:timestamp,timezone:string>,
alerts array<struct<kind:string,threshold_usd:double,condition:string,mode:string,price_basis:string,host:string>>
"""

SNAPSHOT_CSV_COLUMNS = [
    "source", "url", "title", "fetched_at", "brand", "mpn", "attrs", "condition", "is_kit", "kit_module_count",
    "unit_price_usd", "kit_price_usd", "quantity_available", "seller_name", "seller_rating_pct",
    "seller_feedback_count", "ship_from_country", "qvl_status", "flags", "total_for_target_usd",
]

VERDICT_LOG_DDL = (
    "timestamp timestamp, product string, index int, pass boolean, reason string, title string, "
    "price double, url string, source string, source_url string"
)

RUN_CALL_DDL = (
    "slug string, run_ts timestamp, step string, provider string, model string, input_tokens bigint, "
    "output_tokens bigint, cache_read_input_tokens bigint, cache_creation_input_tokens bigint, cost_usd double"
)


def conform(df: DataFrame) -> DataFrame:
    """Bring *df* to the offer schema: missing columns become typed nulls, kit/flag/attr defaults applied."""
    have = set(df.columns)
    out = []
    for name, kind in OFFER_FIELDS:
        col = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        if name == "attrs":
            col = F.coalesce(col, F.create_map().cast(kind))
        elif name == "flags":
            col = F.coalesce(col, F.array().cast(kind))
        elif name == "is_kit":
            col = F.coalesce(col, F.lit(False))
        elif name == "source_order":
            col = F.coalesce(col, F.lit(0))
        elif name == "kit_module_count":
            col = F.coalesce(col, F.lit(1))
        elif name in ("condition", "seller_name", "title", "url"):
            col = F.coalesce(col, F.lit(""))
        elif name == "unit_price_usd":
            col = F.coalesce(col, F.lit(0.0))
        out.append(col.alias(name))
    return df.select(*out)


def offer_struct_type() -> T.StructType:
    return T.StructType.fromDDL(OFFER_DDL)
