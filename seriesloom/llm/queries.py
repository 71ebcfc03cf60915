"""The text operators' queries and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from seriesloom.llm import chat_format, exact_dedup, license_scan, media, mixing, near_dedup, packing, quality, sharding, url_filter

QUERIES = {
    "op5_chat_format": chat_format.op5,
    "op3_media": media.op3,
    "op7_url_filter": url_filter.op7,
    "op1_license_scan": license_scan.op1,
    "op4_near_dedup": near_dedup.op4,
    "op9_quality": quality.op9,
    "op6_packing": packing.op6,
    "op2_mixing": mixing.op2,
    "op8_sharding": sharding.op8,
    "op10_exact_dedup": exact_dedup.op10,
}
ORACLE_SQL = {
    "op5_chat_format": chat_format.OP5_SQL,
    "op8_sharding": sharding.OP8_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op4_near_dedup": near_dedup.OP4_SQL,
    "op7_url_filter": url_filter.OP7_SQL,
    "op1_license_scan": license_scan.OP1_SQL,
    "op10_exact_dedup": exact_dedup.OP10_SQL,
}
