"""Column layouts shared by the operators."""

from pyspark.sql import types as T

CATALOG = T.StructType([
    T.StructField("file_id", T.StringType()),
    T.StructField("checksum", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("path", T.StringType()),
    T.StructField("mime_type", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("batch_no", T.LongType()),
])

# What a lookup, a listing or an export shows of a catalog row.
PUBLIC_FILE_COLUMNS = ["path", "name", "size", "checksum", "mime_type"]

ATTRIBUTES = T.StructType([
    T.StructField("scope", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("default_value", T.StringType()),
    T.StructField("description", T.StringType()),
])
ATTRIBUTE_KEY = ["scope", "key"]

WORD = "struct<line_no:int,word_no:int,text:string,x0:double,top:double,x1:double,bottom:double>"
TABLE = "struct<headers:array<string>,data:array<array<string>>>"
TRANSACTION = (
    "struct<date:string,description:string,amount:double,"
    "category:string,reference:string,mandate:string>"
)
FALLBACK = "struct<error_type:string,error_message:string,resolution_hint:string>"
STATEMENT_DETAILS = (
    "struct<opening_balance:double,closing_balance:double,overdraft_limit:double>"
)

# Fields an AI reply may carry; every one may be missing.
AI_REPLY = (
    "struct<document_type:string,metadata:map<string,string>,text:string,"
    "key_value_pairs:map<string,string>,people:array<string>,"
    "organizations:array<string>,dates:array<string>,amounts:array<string>>"
)
AI_STATEMENT_REPLY = (
    "struct<account_info:struct<holder:string,account_number:string,iban:string,"
    "bic:string,bank:string>,"
    "statement_details:struct<period:string,number:string,opening_balance:double,"
    "closing_balance:double,overdraft_limit:double>,"
    f"transactions:array<{TRANSACTION}>>"
)
