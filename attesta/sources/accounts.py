"""Account rows and what hangs on them: file references, snapshots, contacts."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta import rules
from attesta.functions import text as t


def discover_source_refs(accounts: DataFrame, attachments: DataFrame, notes: DataFrame,
                         file_fields: Sequence[str] = tuple(rules.FILE_FIELDS)) -> DataFrame:
    """A2. One row per file reference of an account: its attachment list, its file fields, the
    attachments of its notes. File items that name no file are skipped."""
    columns = ["account_id", "source", "source_field", "parent_id", "file_ref", "file_name",
               "created_time", "uploaded_by"]
    none = F.lit(None).cast("string")
    listed = attachments.select(
        "account_id", F.lit("ATTACHMENT").alias("source"), none.alias("source_field"),
        none.alias("parent_id"), F.col("id").alias("file_ref"),
        F.col("File_Name").alias("file_name"), F.col("Created_Time").alias("created_time"),
        F.coalesce(F.when(F.col("Created_By.email") != "", F.col("Created_By.email")),
                   F.col("Created_By.name")).alias("uploaded_by"))
    held = accounts.select("account_id", F.explode(F.array(*[
        F.struct(F.lit(f).alias("source_field"), F.col(f).alias("items")) for f in file_fields
    ])).alias("f")).select("account_id", "f.source_field", F.explode("f.items").alias("i"))
    ref = F.coalesce(F.when(F.col("i.attachment_Id") != "", F.col("i.attachment_Id")),
                     F.when(F.col("i.File_Id__s") != "", F.col("i.File_Id__s")))
    held = held.select(
        "account_id", F.lit("FILE_FIELD").alias("source"), "source_field",
        none.alias("parent_id"), ref.alias("file_ref"),
        F.col("i.File_Name__s").alias("file_name"),
        F.lit(None).cast("timestamp").alias("created_time"), none.alias("uploaded_by")
    ).where(F.col("file_ref").isNotNull())
    noted = notes.select("account_id", F.col("id").alias("parent_id"),
                         F.explode("attachments").alias("a")).select(
        "account_id", F.lit("NOTE_ATTACHMENT").alias("source"), none.alias("source_field"),
        "parent_id", F.col("a.id").alias("file_ref"), F.col("a.File_Name").alias("file_name"),
        F.col("a.Created_Time").alias("created_time"), none.alias("uploaded_by"))
    return (listed.select(columns).unionByName(held.select(columns))
            .unionByName(noted.select(columns)))


def snapshot_accounts(accounts: DataFrame, fields: Sequence[str] = tuple(rules.SNAPSHOT_FIELDS),
                      key: str = "account_id") -> DataFrame:
    """A6. The configured account fields; absent ones are null."""
    held = set(accounts.columns)
    return accounts.select(key, *[F.col(f) if f in held else F.lit(None).cast("string").alias(f)
                                  for f in fields if f != key])


def summarise_contacts(contacts: DataFrame) -> DataFrame:
    """A7. Contact rows as the checks need them: name (full, else first and last), email, mobile,
    phone, primary flag and the non-empty role fields. Absent columns count as empty."""
    kinds = dict(contacts.dtypes)

    def col(name):
        return F.col(name) if name in kinds else F.lit(None).cast("string")

    def role(name):
        return (F.array_join(F.col(name), ", ") if kinds[name].startswith("array")
                else F.col(name).cast("string"))

    given = F.concat_ws(" ", F.when(col("First_Name") != "", col("First_Name")),
                        F.when(col("Last_Name") != "", col("Last_Name")))
    primary = F.lit(False)
    for name in rules.PRIMARY_FIELDS:
        primary = primary | F.coalesce(col(name).cast("string").isin("true", "True"),
                                       F.lit(False))
    # one column per name: column names are case-insensitive, the two spellings of one field meet
    roles = {n.lower(): n for n in reversed(rules.ROLE_FIELDS) if n in kinds}
    pairs = [x for n in reversed(list(roles.values())) for x in (F.lit(n), role(n))]
    empty = F.create_map().cast("map<string,string>")
    return contacts.select(
        "account_id", F.coalesce(col("id").cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.when(col("Full_Name") != "", col("Full_Name")),
                   F.when(given != "", given)).alias("name"),
        col("Email").alias("email"), col("Mobile").alias("mobile"), col("Phone").alias("phone"),
        primary.alias("primary"),
        (F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != ""))
         if pairs else empty).alias("roles"),
        *([F.col("contact_pos")] if "contact_pos" in kinds else []))
