"""Record layouts: what arrives on a topic, and what the tables hold.

Change records carry every value as text, so the wire layout of orders,
details and users is all strings; numbers are cast after decoding.
"""

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
)


def _strings(*names):
    return [StructField(n, StringType()) for n in names]


# The field names the producers and downstream consumers agree on.
STARTUP_WIRE = StructType(
    _strings("mid", "uid", "appid", "area", "os", "ch", "type", "vs") + [StructField("ts", LongType())]
)
EVENT_WIRE = StructType(
    _strings("mid", "uid", "appid", "area", "os", "type", "evid", "pgid", "npgid", "itemid")
    + [StructField("ts", LongType())]
)
ORDER_WIRE = StructType(
    _strings(
        "id", "province_id", "consignee", "order_comment", "consignee_tel", "order_status",
        "payment_way", "user_id", "img_url", "total_amount", "expire_time", "delivery_address",
        "create_time", "operate_time", "tracking_no", "parent_order_id", "out_trade_no", "trade_body",
    )
)
DETAIL_WIRE = StructType(
    _strings("id", "order_id", "sku_name", "sku_id", "order_price", "img_url", "sku_num")
)
USER_WIRE = StructType(_strings("id", "login_name", "user_level", "birthday", "gender"))

STARTUP_LOG = StructType(
    STARTUP_WIRE.fields[:-1] + _strings("logDate", "logHour") + [StructField("ts", LongType())]
)
EVENT_LOG = StructType(
    EVENT_WIRE.fields[:-1] + _strings("logDate", "logHour") + [StructField("ts", LongType())]
)
ORDER_INFO = StructType(
    [
        StructField(f.name, DoubleType() if f.name == "total_amount" else f.dataType)
        for f in ORDER_WIRE.fields
    ]
    + _strings("create_date", "create_hour")
)
# `gone` takes an order out of a day it had before.
ORDER_VERSION = StructType(ORDER_INFO.fields + [StructField("gone", BooleanType())])
# What later versions of an order have to take back.
ORDER_PLACE = StructType(
    _strings("id", "create_date", "create_hour") + [StructField("total_amount", DoubleType())]
)
ORDER_HOUR = StructType(
    _strings("create_date", "create_hour")
    + [StructField("orders", LongType()), StructField("total_amount", DecimalType(38, 6))]
)
SALE_DETAIL = StructType(
    _strings("order_detail_id", "order_id", "order_status", "create_time", "user_id", "sku_id", "user_gender")
    + [StructField("user_age", IntegerType())]
    + _strings("user_level")
    + [StructField("sku_price", DoubleType())]
    + _strings("sku_name", "dt")
)
COUPON_ALERT = StructType(
    [
        StructField("alert_id", StringType()),
        StructField("mid", StringType()),
        StructField("uids", ArrayType(StringType())),
        StructField("itemIds", ArrayType(StringType())),
        StructField("events", MapType(StringType(), LongType())),
        StructField("ts", LongType()),
        StructField("dt", StringType()),
    ]
)

COUPON_PANE = StructType(
    _strings("mid", "evid", "uid", "itemid")
    + [StructField("n", LongType()), StructField("ts", LongType()), StructField("stretch", LongType())]
)

# The first record ever of a device; `gone` takes it out of a day it had before.
FIRST_SEEN = StructType(
    _strings("mid") + [StructField("ts", LongType()), StructField("gone", BooleanType())] + _strings("logDate")
)

FIRST_TIME = StructType(_strings("mid") + [StructField("ts", LongType())])

CDC_ENTRY = StructType(
    _strings("entry_type", "table_name", "event_type")
    + [
        StructField("ts", LongType()),
        StructField("rows", ArrayType(ArrayType(StructType(_strings("name", "value"))))),
    ]
)

# Topic names used by the routing operators.
STARTUP_TOPIC = "startup_log"
EVENT_TOPIC = "event_log"
ORDER_TOPIC = "order_info"
DETAIL_TOPIC = "order_detail"
USER_TOPIC = "user_info"
