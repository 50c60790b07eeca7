"""Decoding of chain event logs and traces with column expressions; words of 256 bits stay decimal text or limbs."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.cleaning import TRANSFER_TOPICS, hex_limbs, limbs_total, topic_address

#: Event topics by signature; Spark has no Keccak, so they are constants.
TOPICS = {
    "Transfer(address,address,uint256)": TRANSFER_TOPICS[0], "TransferSingle(address,address,address,uint256,uint256)": TRANSFER_TOPICS[1], "TransferBatch(address,address,address,uint256[],uint256[])": TRANSFER_TOPICS[2],
    "Approval(address,address,uint256)": "0x8c5be1e5ebec7d5bd14f71427d1e84f3dd0314c0f7b2291e5b200ac8c7c3b925",
    "Swap(address,uint256,uint256,uint256,uint256,address)": "0xd78ad95fa46c994b6551d0da85fc275fe613ce37657fb8d5e3d130840159d822",
    "Swap(address,address,int256,int256,uint160,uint128,int24)": "0xc42079f94a6350d7e6235f29174924f928cc2ac818eb64fed8004e115fbcca67",
}
#: Which kind of registry entry is believed first.
PRIORITY = {"VERIFIED_ABI": 1, "PROTOCOL_ABI": 2, "LOCAL_ABI": 3, "TOPIC0": 4, "RAW": 5}


def word(data: Column, i: Column | int) -> Column:
    """The i-th 32-byte word of ABI data as 64 hex digits, null if the data ends before."""
    start = (F.lit(i) if isinstance(i, int) else i) * 64 + 3
    w = F.substring(data, start, F.lit(64))
    return F.when(F.length(w) == 64, w)


def word_number(w: Column) -> Column:
    """A word as decimal(38,0); null where it needs more digits."""
    return limbs_total(hex_limbs(w))


def word_int(w: Column) -> Column:
    """A word that holds a small number (an offset, a length), null if it doesn't fit."""
    return F.when(F.substring(w, 1, 49).rlike("^0+$"), F.conv(F.substring(w, 50, 15), 16, 10).try_cast("bigint"))


def word_address(w: Column) -> Column:
    return F.concat(F.lit("0x"), F.substring(w, 25, 40))


def signed_word(w: Column) -> Column:
    """A two's complement word as decimal(38,0)."""
    negative = F.substring(w, 1, 1).isin(*"89abcdef")
    flipped = F.translate(F.lower(w), "0123456789abcdef", "fedcba9876543210")
    return F.when(negative, -(word_number(flipped) + 1)).otherwise(word_number(w)).try_cast("decimal(38,0)")


def decode_transfers(logs: DataFrame) -> DataFrame:
    """Token transfers of logs (topic0..3, data, address, and keys): standard, from, to, token_id, value, batch_index.

    ERC-20 has three topics, ERC-721 four; of ERC-1155 from and to are topics 2 and 3 (topic 1 is the operator), and each pair of a batch is a
    row. A batch whose arrays don't fit its data, or differ in length, gives no row.
    """
    keys = [c for c in logs.columns if c not in ("topic0", "topic1", "topic2", "topic3", "data")]
    t0, data = F.lower("topic0"), F.lower("data")
    base = logs.withColumn("data", data)
    erc = base.filter(t0 == TRANSFER_TOPICS[0])
    nft = F.col("topic3").isNotNull() & (F.col("topic3") != "")
    plain = erc.select(*keys, F.when(nft, "ERC721").otherwise("ERC20").alias("standard"), topic_address(F.col("topic1")).alias("sender"), topic_address(F.col("topic2")).alias("receiver"), F.when(nft, F.lower(F.col("topic3"))).alias("token_id"), F.when(nft, F.lit(1).cast("decimal(38,0)")).otherwise(word_number(word(F.col("data"), 0))).alias("value"), F.lit(0).alias("batch_index"))
    single = base.filter(t0 == TRANSFER_TOPICS[1]).select(*keys, F.lit("ERC1155").alias("standard"), topic_address(F.col("topic2")).alias("sender"), topic_address(F.col("topic3")).alias("receiver"), F.concat(F.lit("0x"), word(F.col("data"), 0)).alias("token_id"), word_number(word(F.col("data"), 1)).alias("value"), F.lit(0).alias("batch_index"))
    d = F.col("data")
    at = lambda i: F.floor(word_int(word(d, i)) / 32)
    b = base.filter(t0 == TRANSFER_TOPICS[2]).withColumn("ia", at(0)).withColumn("va", at(1)).withColumn("n", word_int(word(d, F.col("ia")))).withColumn("m", word_int(word(d, F.col("va"))))
    words = (F.length(d) - 2) / 64
    b = b.filter((F.col("n") == F.col("m")) & (F.col("n") > 0) & (F.col("ia") + 1 + F.col("n") <= words) & (F.col("va") + 1 + F.col("n") <= words))
    b = b.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    batch = b.select(*keys, F.lit("ERC1155").alias("standard"), topic_address(F.col("topic2")).alias("sender"), topic_address(F.col("topic3")).alias("receiver"), F.concat(F.lit("0x"), word(d, F.col("ia") + 1 + F.col("k"))).alias("token_id"), word_number(word(d, F.col("va") + 1 + F.col("k"))).alias("value"), F.col("k").cast("int").alias("batch_index"))
    return plain.unionByName(single).unionByName(batch)


def choose_definitions(registry: DataFrame) -> DataFrame:
    """Per topic0 and contract (null: any) the definition that is believed first; equal ranks that differ are ambiguous."""
    rank = F.lit(9)
    for k, v in PRIORITY.items():
        rank = F.when(F.col("source") == k, v).otherwise(rank)
    r = registry.withColumn("rank", rank)
    best = r.groupBy("topic0", "contract").agg(F.min("rank").alias("rank"))
    g = r.join(best, (r.topic0 == best.topic0) & r.contract.eqNullSafe(best.contract) & (r.rank == best.rank)).groupBy(r.topic0, r.contract)
    return g.agg(F.min("event_name").alias("event_name"), (F.countDistinct("event_name") > 1).alias("ambiguous"))


def outcome(event: Column, ambiguous: Column, data: Column, words_needed: Column) -> Column:
    """Decoded, ambiguous, raw (no definition) or decode_error (data too short)."""
    return F.when(event.isNull(), "raw").when(ambiguous, "ambiguous").when((F.length(data) - 2) / 64 < words_needed, "decode_error").otherwise("decoded")


def internal_transfers(traces: DataFrame) -> DataFrame:
    """P25: successful traces that move value between two known addresses."""
    return traces.filter((F.col("value") > 0) & (F.upper("status") == "SUCCESS") & (F.coalesce("from_address", F.lit("")) != "") & (F.coalesce("to_address", F.lit("")) != ""))


def v2_swap(a0in: Column, a1in: Column, a0out: Column, a1out: Column) -> Column:
    """The direction of a two-token swap; null unless exactly one token comes in and the other goes out."""
    return F.when((a0in > 0) & (a1in == 0) & (a1out > 0) & (a0out == 0), "0_to_1").when((a1in > 0) & (a0in == 0) & (a0out > 0) & (a1out == 0), "1_to_0")


def bridge_way(event_name: Column) -> Column:
    """P26."""
    s = F.lower(event_name)
    return F.when(s.rlike("deposit|lock|send|outbound"), "BRIDGE_OUT").when(s.rlike("withdraw|release|receive|unlock|inbound|mint"), "BRIDGE_IN")


def pool_flow(amount0: Column, amount1: Column) -> Mapping[str, Column]:
    """What goes into a pool is positive: token and amount in and out of a swap."""
    zero_in = (amount0 > 0) & (amount1 < 0)
    one_in = (amount1 > 0) & (amount0 < 0)
    return {"token_in": F.when(zero_in, 0).when(one_in, 1), "token_out": F.when(zero_in, 1).when(one_in, 0), "amount_in": F.when(zero_in, amount0).when(one_in, amount1), "amount_out": F.when(zero_in, -amount1).when(one_in, -amount0)}


def v3_spot(sqrt_price_x96: Column, decimals0: Column, decimals1: Column) -> Column:
    """Token 1 per token 0 from a square-root price with 96 binary places, as double."""
    root = sqrt_price_x96.cast("double") / F.lit(2.0**96)
    return root * root * F.pow(F.lit(10.0), decimals0 - decimals1)
