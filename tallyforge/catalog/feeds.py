"""Feeds: their smaller formats and the functions that read their values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import normalise as N
from tallyforge.queries import query
from tallyforge.sources import delimited, fixed_width

DEC = "DECIMAL(20,4)"
c = F.col


def sheet(v) -> DataFrame:
    service = F.when(c("service") == "SCT", "rcp").when(c("service") == "SDD", "RCC").when(c("service") == "INST", "NCP").when(c("service") == "RET", "").otherwise("WCC")
    blank = c("link_id") % 5 == 4
    return v.link.select(
        F.when(~blank, c("pmsgid")).alias(" MsgId"), F.when(~blank, service).alias("ServiceID"), F.when(c("link_id") % 7 == 0, "many").otherwise(c("announced").cast("string")).alias("Num_Records"), F.replace(c("booked").cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(",")).alias("SettlementAmt")
    )


SERVICE = "CASE service WHEN 'SCT' THEN 'RCP' WHEN 'SDD' THEN 'RCC' WHEN 'INST' THEN 'NCP' WHEN 'RET' THEN '?' ELSE 'WCC' END"
query(
    "source_link_rows",
    "link",
    f"SELECT pmsgid, {SERVICE} AS service, CASE WHEN link_id % 7 = 0 THEN 0 ELSE announced END AS announced, CAST(CAST(booked AS DECIMAL(20,2)) AS {DEC}) AS booked FROM link WHERE link_id % 5 <> 4 AND {SERVICE} IN ('RCP', 'RCC', 'WCC')",
)(lambda v: delimited.link_rows(sheet(v))[0])
query("source_link_counts", "link", f"SELECT {SERVICE} AS service, count(*) AS n, {SERVICE} IN ('RCP', 'RCC', 'WCC') AS kept FROM link WHERE link_id % 5 <> 4 GROUP BY ALL")(lambda v: delimited.link_rows(sheet(v))[1])
query(
    "source_rejoined",
    "dump",
    """SELECT dump_id, 0 AS place, CASE WHEN dump_id % 3 = 0 THEN srl WHEN dump_id % 3 = 1 THEN pmsgid || ';"' || srl || '";x' || chr(10) || 'goes on' ELSE '"' || srl || '";y' END AS value FROM dump
      UNION ALL SELECT dump_id, 1, 'bare;1' FROM dump""",
)(
    lambda v: delimited.rejoined(
        v.dump.select(
            "dump_id",
            F.when(c("dump_id") % 3 == 0, F.concat(c("srl"), F.lit("\n\nbare;1\n")))
            .when(c("dump_id") % 3 == 1, F.concat(F.lit('"?column?"\r\n"'), "pmsgid", F.lit(';""'), "srl", F.lit('"";x\r\ngoes on"\nbare;1')))
            .otherwise(F.concat(F.lit('?column?\n"""'), "srl", F.lit('"";y" \nbare;1')))
            .alias("value"),
        )
    )
)


def slabs(v) -> DataFrame:
    pad = lambda x, n: F.rpad(x, n, " ")
    record = F.concat(
        F.lit("1"), pad(c("o_orderkey").cast("string"), 30), pad(F.lit("sent"), 30), pad(F.when(c("o_orderkey") % 4 == 0, "WITHDRAW").otherwise("DEPOSIT"), 8), pad(F.lit("P1"), 12), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("EUR"),
        F.lpad(F.replace(c("o_totalprice").cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(",")), 27, " "), pad(F.concat(F.lit("R"), c("o_orderkey").cast("string")), 20), F.lit("Y"),
    )
    filled = F.concat(record, F.lit(" " * (3269 - 140)))
    return v.orders.select(F.concat(F.rpad(F.lit("0HEAD"), 3269, " "), filled, filled, F.lit("9END")).alias("value"))


query(
    "source_slabs",
    "",
    f"""SELECT o_orderkey::VARCHAR AS counter, CAST(CASE WHEN o_orderkey % 4 = 0 THEN -1 ELSE 1 END * CAST(o_totalprice AS DECIMAL(20,2)) AS {DEC}) AS amount, 'R' || o_orderkey AS ref
      FROM orders, (SELECT unnest([1, 2]) AS i)""",
)(lambda v: fixed_width.slab_rows(slabs(v)).filter("_error is null").select("counter", "amount", "ref"))
query("map_prefixed_key", "movement", "SELECT movement_id, CASE WHEN movement_id % 10 = 0 THEN nullif(trim(ref_no), '') WHEN movement_id % 3 = 0 THEN 'K' || movement_id ELSE 'X' || movement_id END AS reco_id FROM movement")(
    lambda v: v.movement.select("movement_id", N.without_prefix(F.expr("CASE WHEN movement_id % 10 = 0 THEN ' ' WHEN movement_id % 3 = 0 THEN 'SCRTK' || movement_id ELSE 'X' || movement_id END"), "SCRT", c("ref_no")).alias("reco_id"))
)
query("map_operation_type", "payment", "SELECT po_id, CASE init_module WHEN 'WEB' THEN 'P2P' WHEN 'MULTI' THEN 'EMC' WHEN 'SINGLE' THEN CASE WHEN part_key % 2 = 0 THEN 'UNKNOWN' ELSE 'SINGLE' END END AS kind FROM payment")(
    lambda v: v.payment.select("po_id", N.operation_type(F.when(c("init_module") == "WEB", " wero").when(c("init_module") == "MULTI", "WeroEmc").when(c("part_key") % 2 == 1, "single")).alias("kind"))
)
HEX = "md5(po_id)"
DASHED = f"left({HEX}, 8) || '-' || substr({HEX}, 9, 4) || '-' || substr({HEX}, 13, 4) || '-' || substr({HEX}, 17, 4) || '-' || substr({HEX}, 21)"
query("map_uuid_variants", "payment", f"SELECT po_id, CASE part_key % 3 WHEN 0 THEN {HEX} || ',' || {DASHED} WHEN 1 THEN {DASHED} || ',' || {HEX} ELSE 'plain' END AS variants FROM payment")(
    lambda v: v.payment.select("po_id", F.array_join(N.uuid_variants(F.expr(f"CASE part_key % 3 WHEN 0 THEN {HEX} WHEN 1 THEN {DASHED} ELSE 'plain' END")), ",").alias("variants"))
)
query("map_export_family", "dump", "SELECT dump_id, 'event' || (dump_id % 5) || CASE dump_id % 4 WHEN 0 THEN '_o' WHEN 1 THEN '_o' WHEN 2 THEN '_i' ELSE '' END AS family FROM dump")(
    lambda v: v.dump.select("dump_id", N.export_family(F.expr("'Event' || (dump_id % 5) || CASE dump_id % 4 WHEN 0 THEN '_O.csv' WHEN 1 THEN '_0.CSV' WHEN 2 THEN '_i.csv' ELSE '.csv' END")).alias("family"))
)
CODED = "CASE movement_id % 4 WHEN 0 THEN 'D1' WHEN 1 THEN 'C1' WHEN 2 THEN 'P1' ELSE NULL END"
SIGNED = "CASE WHEN movement_id % 3 = 0 THEN -amount ELSE amount END"


def coded(v) -> DataFrame:
    direction, amount, unknown = N.coded_direction(F.expr(CODED), {"D1": "DEBIT", "C1": "CREDIT"}, ["P1"], F.expr(SIGNED))
    return v.movement.select("movement_id", direction.alias("direction"), amount.alias("amount"), unknown.alias("unknown"))


query(
    "map_coded_direction",
    "movement",
    f"""SELECT movement_id, d AS direction, CAST(CASE WHEN d = 'DEBIT' THEN -abs(amount) ELSE abs(amount) END AS {DEC}) AS amount, movement_id % 4 = 2 AS unknown FROM
      (SELECT *, CASE WHEN movement_id % 4 = 0 THEN 'DEBIT' WHEN movement_id % 4 = 1 THEN 'CREDIT' WHEN movement_id % 3 = 0 AND amount > 0 THEN 'DEBIT' ELSE 'CREDIT' END AS d FROM movement)""",
)(coded)
query(
    "map_movement_type",
    "movement",
    "SELECT movement_id, left(coalesce(nullif(upper(trim(string_split(particulars, CASE WHEN contains(particulars, '##') THEN '##' ELSE '/' END)[1])), ''), 'SCTXB'), 16) AS kind FROM movement",
)(lambda v: v.movement.select("movement_id", N.movement_type(c("particulars")).alias("kind")))
query(
    "map_channel",
    "movement",
    """SELECT movement_id, CASE WHEN movement_id % 2 = 0 THEN channel WHEN movement_id % 3 = 0 THEN 'Q' || (movement_id % 7) END AS channel, coalesce(nullif(trim(ref_no), ''), remarks_1, '') AS ref, strftime(value_date, '%Y-%m-%dT%H:%M:%S') AS at FROM movement""",
)(
    lambda v: v.movement.select(
        "movement_id",
        N.channel_of(F.when(c("movement_id") % 2 == 0, F.lower("channel")).otherwise(" "), F.when(c("movement_id") % 3 == 0, F.concat(F.lit('{"Initiating_channel": "q'), (c("movement_id") % 7).cast("string"), F.lit('"}')))).alias("channel"),
        F.coalesce(N.first_filled(c("ref_no"), c("remarks_1")), F.lit("")).alias("ref"),
        N.iso_moment(c("value_date")).alias("at"),
    )
)
