"""Facts tables derived from the given tables. Each is a lazy DataFrame over the whole input."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ordered

PAGE_CHARS = 1000
PRO_PRICE = "pri_pro"

# The base luminance table of the standard JPEG quality formula (row by row).
BASE_LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]


def choose(index: Column, values: list, cast: str | None = None) -> Column:
    """values[index] as a CASE, so the optimiser sees plain literals."""
    out = None
    for i, v in enumerate(values):
        lit = F.lit(v) if cast is None else F.lit(v).cast(cast)
        out = F.when(index == i, lit) if out is None else out.when(index == i, lit)
    return out


def page_count(text: str) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.length(text) / float(PAGE_CHARS)).cast("long"))


class Tables:
    """The given tables and the facts tables over them, for one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # -- documents ----------------------------------------------------------------------------

    @cached_property
    def doc_pages(self) -> DataFrame:
        d = self.documents.select("doc_id", "text", page_count("text").alias("page_count"))
        d = d.select("doc_id", "text", "page_count",
                     F.explode(F.sequence(F.lit(0).cast("long"), F.col("page_count") - 1)).alias("page_index"))
        text = F.substring(F.col("text"), (F.col("page_index") * PAGE_CHARS + 1).cast("int"), F.lit(PAGE_CHARS))
        return d.select("doc_id", "page_index", "page_count", text.alias("text"))

    @cached_property
    def doc_page_index(self) -> DataFrame:
        """Page numbers alone. They follow the text itself: a stale character count would lose pages."""
        d = self.documents.select("doc_id", page_count("text").alias("page_count"))
        return d.select("doc_id", "page_count",
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("page_count") - 1)).alias("page_index"))

    @cached_property
    def layer_pages(self) -> DataFrame:
        """Pages of documents labelled good: the ones that already carry a text layer."""
        good = self.labels.where("quality = 1").select("doc_id")
        return self.doc_pages.join(good, "doc_id", "left_semi")

    @cached_property
    def words(self) -> DataFrame:
        w = self.doc_pages.select("doc_id", "page_index", F.posexplode(F.split("text", r"[^\p{L}]+")).alias("ordinal", "word"))
        n, pos = F.length("word"), F.col("ordinal")
        return w.select(
            "doc_id", "page_index", pos.cast("long").alias("ordinal"), "word",
            ((n * 17 + pos * 7) % 101).cast("long").alias("confidence"),
            ((pos % 10) * 50).cast("long").alias("x0"), (F.floor(pos / 10) * 30).cast("long").alias("y0"),
            ((pos % 10) * 50 + n * 4).cast("long").alias("x1"),
            (F.floor(pos / 10) * 30 + (pos % 7) * 4).cast("long").alias("y1"))

    # -- files --------------------------------------------------------------------------------

    @cached_property
    def files(self) -> DataFrame:
        k = F.col("p_partkey")
        ext = choose(k % 8, ["pdf", "docx", "xlsx", "odt", "epub", "doc", "xls", "bin"])
        head = choose(k % 9, ["255044462D312E37", "504B030414000600", "D0CF11E0A1B11AE1", "FFD8FFE000104A46",
                              "89504E470D0A1A0A", "474946383961", "524946460000000057454250", "7B226B", "00010203"])
        return self.part.select(
            k.alias("file_id"), F.concat(F.translate("p_name", " ", "-"), F.lit("."), ext).alias("name"),
            F.when(k % 41 == 0, F.lit(0)).otherwise(F.floor(F.col("p_retailprice") * 64000)).cast("long").alias("size"),
            F.unhex(head).alias("head"),
            choose(k % 10, ["PasswordException", "InvalidPDFException", "RangeError", "QuotaExceededError",
                            "Error", "Error", "Error", "Error", "Error", "Error"]).alias("error_name"),
            (F.col("p_size") % 3).cast("long").alias("error_code"),
            choose(k % 9, ["Input document is encrypted", "No PDF header found", "Failed to parse PDF document",
                           "Expected instance of PDFDict", "Unbalanced parenthesis", "Expected object number",
                           "the parser stalled", "something else",
                           "Failed to parse PDF document: it is encrypted"]).alias("error_message"))

    @cached_property
    def file_pages(self) -> DataFrame:
        li = self.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                                  "l_shipdate", "l_quantity", "l_discount", "l_tax")
        order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity",
                 "l_discount", "l_tax"]
        n = ordered.number(li, ["l_orderkey"], order, ordered.chunk_of("l_linenumber"), "n")
        size = F.col("l_linenumber") % 5
        return n.select(
            F.col("l_orderkey").alias("doc_id"), (F.col("n") - 1).alias("page_index"),
            choose(size, [595, 842, 612, 612, 420], "double").alias("width_pt"),
            choose(size, [842, 595, 792, 1008, 595], "double").alias("height_pt"),
            (F.col("l_partkey") % 4 * 90).cast("long").alias("rotation"))

    # -- images -------------------------------------------------------------------------------

    @cached_property
    def placements(self) -> DataFrame:
        q = F.col("l_quantity")
        return self.lineitem.where("l_returnflag <> 'R'").select(
            F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("image_key"),
            F.col("l_linenumber").cast("long").alias("page_index"),
            (q * 8).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), (q * 10).alias("d"))

    @cached_property
    def masks(self) -> DataFrame:
        return (self.lineitem.where("l_linestatus = 'O' and l_returnflag = 'A' and l_quantity <= 3")
                .select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("image_key")).distinct())

    @cached_property
    def images(self) -> DataFrame:
        uses = self.lineitem.groupBy(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("image_key")).agg(
            F.max(F.floor("l_extendedprice")).cast("long").alias("encoded_bytes"), F.min("l_orderkey").alias("ordinal"))
        k = F.col("image_key")
        chain = choose(k % 7, ["DCTDecode", "FlateDecode", "JBIG2Decode", "JPXDecode", "CCITTFaxDecode", "", "ASCII85Decode"])
        chain = F.when(k % 31 == 0, F.lit("FlateDecode,DCTDecode")).otherwise(chain)
        filters = F.filter(F.split(chain, ","), lambda x: x != "")
        return uses.join(self.part.select("p_partkey", "p_size"), F.col("p_partkey") == k).select(
            "doc_id", "image_key", "ordinal", "encoded_bytes",
            F.when(k % 19 == 0, F.lit(0)).otherwise(F.col("p_size") * 60).cast("long").alias("width"),
            (F.col("p_size") * 80).cast("long").alias("height"),
            F.when(k % 11 == 0, F.lit(1)).when(k % 23 == 0, F.lit(16)).otherwise(F.lit(8)).cast("long").alias("bpc"),
            (k % 29 == 0).alias("is_mask"), filters.alias("filters"),
            choose(k % 6, ["DeviceRGB", "DeviceGray", "Indexed", "ICCBased", "DeviceCMYK"]).alias("color_space"),
            F.when((k % 7 == 0) & (k % 5 != 0), k % 101).cast("long").alias("quality"))

    @cached_property
    def fonts(self) -> DataFrame:
        """Font programs by reference; several descriptors may share one."""
        return self.lineitem.select(F.col("l_suppkey").alias("doc_id"), (F.col("l_partkey") % 40).alias("font_ref"),
                                    ((F.col("l_partkey") % 40) * 1000 + F.col("l_suppkey")).alias("font_bytes"))

    @cached_property
    def quant_tables(self) -> DataFrame:
        e = self.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
        base = F.array(*[F.lit(v) for v in BASE_LUMA])
        free = F.transform("e", lambda x: (F.floor(F.abs(x) * 200.0) % 254 + 1).cast("int"))
        q = (F.col("vec_id") % 99 + 1).cast("int")
        scale = F.when(q < 50, F.floor(F.lit(5000) / q)).otherwise(F.lit(200) - q * 2).cast("int")
        made = F.transform(base, lambda b: F.least(F.lit(255), F.greatest(F.lit(1), F.floor((b * scale + 50) / 100))).cast("int"))
        return (e.select("vec_id", F.lit("free").alias("origin"), F.lit(None).cast("int").alias("made_at"), free.alias("tbl"))
                .unionByName(e.select("vec_id", F.lit("scaled").alias("origin"), q.alias("made_at"), made.alias("tbl"))))

    @cached_property
    def size_measurements(self) -> DataFrame:
        p = self.part.select(F.col("p_partkey").alias("file_id"), F.col("p_retailprice").alias("price"),
                             F.explode(F.sequence(F.lit(0), F.lit(8))).alias("s"))
        swapped = F.when((F.col("file_id") % 9 == 0) & (F.col("s") == 3), 4).when(
            (F.col("file_id") % 9 == 0) & (F.col("s") == 4), 3).otherwise(F.col("s"))
        size = F.floor(F.col("price") * 1024.0 * (F.lit(100) - swapped * 8) / 100.0).cast("long")
        share = choose(F.col("file_id") % 4, [110, 60, 40, 33], "double")
        return p.select("file_id", F.col("s").cast("long").alias("step"), size.alias("size"),
                        F.floor(F.col("price") * 1024.0).cast("long").alias("original"),
                        F.floor(F.col("price") * 1024.0 * share / 100.0).cast("long").alias("target"))

    # -- outlines -----------------------------------------------------------------------------

    @cached_property
    def outline(self) -> DataFrame:
        t = F.col("turn")
        parent = F.when(F.col("role") == "assistant", t - 1).when((F.col("role") == "user") & (t % 4 == 2), t - 2)
        return self.conversations.select(
            F.col("conv_id").alias("doc_id"), t.alias("node_id"), parent.alias("parent_id"), t.alias("ordinal"),
            F.substring_index("text", "\n", 1).alias("title"), F.when(t % 5 != 4, t * 2).alias("page_index"), "role")

    @cached_property
    def outline_docs(self) -> DataFrame:
        return self.conversations.groupBy(F.col("conv_id").alias("doc_id")).agg((F.count("*") * 2 - 2).alias("page_count"))

    @cached_property
    def outline_pages(self) -> DataFrame:
        d = self.outline_docs.where("page_count > 0")
        return d.select("doc_id", "page_count",
                        F.explode(F.sequence(F.lit(0).cast("long"), F.col("page_count") - 1)).alias("page_index"))

    # -- runs, purchases, survey, requests -----------------------------------------------------

    @cached_property
    def run_results(self) -> DataFrame:
        v = F.col("value")
        kind = (F.when(v < 5, F.lit("failed")).when(v < 10, F.lit("left-alone")).when(v < 11, F.lit("interrupted"))
                .when(v < 12, F.lit("not-attempted")).otherwise(F.lit("done")))
        return self.events.select(
            F.col("user_id").alias("run_id"), F.col("event_id").alias("ordinal"),
            F.concat("event_type", F.when(F.col("event_id") % 37 == 0, F.lit(" (2).pdf")).otherwise(F.lit(".pdf"))).alias("source"),
            kind.alias("kind"), F.floor(v * 1000).cast("long").alias("bytes"))

    @cached_property
    def purchase_fields(self) -> DataFrame:
        i, v, t = F.col("event_id"), F.col("value"), F.col("event_type")
        bare = i % 7 == 0
        event_type = (F.when(t == "purchase", F.lit("transaction.completed")).when(t == "signup", F.lit("adjustment.updated"))
                      .when((t == "view") & (i % 2 == 1), F.lit("customer.created")).otherwise(F.lit("adjustment.created")))
        action = (F.when(t.isin("error", "signup"), F.lit("refund"))
                  .when((t == "click") & (v < 20), F.lit("chargeback")).when(t == "click", F.lit("chargeback_reverse"))
                  .when((t == "view") & (i % 2 == 0), F.lit("credit")))
        status = (F.when(t == "signup", F.lit("pending_approval"))
                  .when((t == "click") & (v < 20) & (i % 5 == 0), F.lit("reversed"))
                  .when((t == "click") & (v >= 20) & (i % 5 == 0), F.lit("rejected"))
                  .when(t != "purchase", F.lit("approved")))
        kind = F.when(t == "error", F.when(bare, choose(i % 3, ["partial", "full"])).otherwise(F.lit("partial")))
        return self.events.select(
            i.alias("event_id"), (i * 7919 % 1000003 + F.floor(i / 1000003) * 1000003).alias("arrival_seq"), F.col("ts").alias("ts"),
            event_type.alias("event_type"),
            F.when(i % 61 == 0, F.lit(None)).when(i % 67 == 0, F.lit("not a date"))
            .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("occurred_at"),
            F.when(i % 53 == 0, F.lit("  ")).otherwise(F.concat(F.lit("txn_"), F.col("user_id"))).alias("txn"),
            action.alias("action"), status.alias("status"), kind.alias("kind"),
            F.when((t == "error") & ~bare, F.when(v < 20, F.lit("full")).otherwise(F.lit("partial"))).alias("item_type"),
            F.when(t == "purchase", F.when(i % 23 == 0, F.lit("pri_other")).otherwise(F.lit(PRO_PRICE))).alias("price_id"),
            F.when((t == "purchase") & (i % 10 != 0), F.concat(F.lit("u"), F.col("user_id"))).alias("uid"),
            F.when(t == "purchase", F.concat(F.lit("U"), F.col("user_id"), F.lit("@Example.com"))).alias("email"))

    @cached_property
    def deliveries(self) -> DataFrame:
        """Stored deliveries: the body text as received. Some bodies are cut short and do not parse."""
        f = self.purchase_fields
        sale = F.col("event_type") == "transaction.completed"
        item = F.struct(F.col("item_type").alias("type"),
                        F.when(F.col("price_id").isNotNull(), F.struct(F.col("price_id").alias("id"))).alias("price"))
        data = F.struct(
            F.when(sale, F.col("txn")).alias("id"), F.when(~sale, F.col("txn")).alias("transaction_id"), "action", "status",
            F.col("kind").alias("type"),
            F.when(F.col("item_type").isNotNull() | F.col("price_id").isNotNull(), F.array(item)).alias("items"),
            F.when(sale, F.struct("uid", "email")).alias("custom_data"))
        raw = F.to_json(F.struct(F.concat(F.lit("evt_"), F.col("event_id")).alias("event_id"), "event_type", "occurred_at", data.alias("data")))
        raw = F.when(F.col("event_id") % 29 == 0, F.substring(raw, 1, 20)).otherwise(raw)
        return f.select("event_id", "arrival_seq", "ts", raw.alias("raw"))

    @cached_property
    def survey(self) -> DataFrame:
        i, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("long")
        address = F.concat(F.lit(" U"), F.col("user_id"), F.when(i % 33 == 0, F.lit("@bad ")).otherwise(F.lit("@Example.com ")))
        return self.events.where("event_type = 'signup'").select(
            i.alias("event_id"), F.col("ts").alias("at"), address.alias("email"),
            choose(k % 6, [" ", "lawyer", "accountant", "architect", "teacher", "nurse "]).alias("profession"),
            F.when(k % 4 != 0, F.concat(F.lit("task "), k)).alias("spends_too_long"),
            F.when(k % 7 == 0, F.repeat(F.lit("x"), 201)).when(k % 3 == 0, F.lit("weekly")).alias("cadence"),
            F.when(k % 25 == 0, F.lit("Acme")).otherwise(F.lit(" ")).alias("company"))

    @cached_property
    def requests(self) -> DataFrame:
        i = F.col("event_id")
        n = self.pages.agg(F.count("*")).scalar()
        e = self.events.withColumn("page_id", i % n)
        e = e.join(self.pages.select("page_id", "url"), "page_id")
        return e.select(
            i.alias("event_id"), F.col("user_id").alias("session"), F.col("ts").alias("at"),
            choose(i % 3, ["arrival", "open", "pay"]).alias("phase"), "url", F.col("event_type").alias("rtype"),
            F.when(i % 50 == 0, F.lit(-1)).otherwise(F.floor(F.col("value") * 100)).cast("long").alias("bytes"),
            F.when(F.col("event_type") == "error", F.lit("policy")).alias("blocked"))

    # -- measurement ---------------------------------------------------------------------------

    @cached_property
    def rungs(self) -> DataFrame:
        g = self.part.groupBy(F.col("p_brand").alias("run"), F.col("p_size").cast("long").alias("mb")).agg(
            F.min("p_partkey").alias("k"), F.min_by("p_retailprice", "p_partkey").alias("price"),
            F.min_by("p_type", "p_partkey").alias("phase"))
        k, mb = F.col("k"), F.col("mb")
        number = F.regexp_extract("run", r"(\d+)$", 1).cast("long")
        pipe = F.when(k % 37 == 0, F.lit(10)).when(number % 3 == 0, mb * 400).otherwise(F.floor(F.col("price") * 10)).cast("long")
        built = F.when(k % 43 == 0, F.lit(None)).when(k % 19 == 0, mb * 524288).otherwise(mb * 1048576).cast("long")
        return g.select(
            "run", "mb", "phase",
            F.when(k % 29 == 0, F.lit("threw")).when(k % 31 == 0, F.lit("started")).otherwise(F.lit("survived")).alias("outcome"),
            pipe.alias("pipe_ms"), built.alias("built_bytes"),
            F.when(k % 47 == 0, F.floor(built / 3)).otherwise(built).cast("long").alias("saved_bytes"),
            F.when(k % 59 == 0, F.lit(0)).otherwise(mb).cast("long").alias("pages_seen"),
            F.when(k % 13 == 0, F.lit(0)).when(number % 2 == 0, F.lit(6)).otherwise(mb).cast("long").alias("recompressed"),
            (k % 5).cast("long").alias("skipped"))

    @cached_property
    def packages(self) -> DataFrame:
        return self.part.select(
            F.concat("p_name", F.lit("-"), "p_partkey").alias("name"), F.concat(F.lit("1."), "p_size").alias("version"),
            choose(F.col("p_partkey") % 7, ["MIT", "Apache-2.0", "(MIT OR GPL-3.0)", "GPL-3.0", "AGPL-3.0-only",
                                            "BSD-3-Clause", "Custom"]).alias("licence"))

    @cached_property
    def stages(self) -> DataFrame:
        s, k = F.col("p_size").cast("long"), F.col("p_partkey")
        return self.part.select(F.col("p_brand").alias("run"), k.alias("rung"), F.create_map(
            F.lit("parse"), s * 3 + 1, F.lit("analyse"), k % 50 + 1, F.lit("recompress"), s * 20 + 7,
            F.lit("save"), k % 90 + 2).alias("stages"))

    @cached_property
    def edges(self) -> DataFrame:
        p = self.pages.select("page_id")
        to = F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2,
                     F.when(F.col("page_id") % 25 == 0, F.col("page_id") + 7))
        e = p.select(F.col("page_id").alias("src"), F.explode(F.array_compact(to)).alias("dst"))
        return e.join(p.select(F.col("page_id").alias("dst")), "dst", "left_semi").select("src", "dst")

    @cached_property
    def stash_events(self) -> DataFrame:
        return self.events.select("event_id", F.col("user_id").alias("owner"), F.col("ts").alias("at"), choose_event().alias("what"))


def choose_event() -> Column:
    t = F.col("event_type")
    return (F.when(t == "view", F.lit("stash")).when(t == "click", F.lit("claim")).when(t == "purchase", F.lit("pending"))
            .when(t == "error", F.lit("confirm")).otherwise(F.lit("other")))
