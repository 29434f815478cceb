"""Mail files by the standard library; Outlook files by an optional one."""

from __future__ import annotations

import email
from email import policy
from email.message import EmailMessage

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from adjudica.sources.files import ending, html_text

FIELDS = "type string, body string, sender string, recipient string, subject string, sent string, attachments array<struct<name:string,content:binary>>"


def nothing(kind: str) -> dict:
    return {"type": kind, "body": "", "sender": "", "recipient": "", "subject": "", "sent": "", "attachments": []}


def safe(name: str) -> str:
    return name.rsplit("/", 1)[-1].replace("..", "").replace("/", "_")


def content_of(part: EmailMessage) -> str:
    try:
        return str(part.get_content())
    except (LookupError, KeyError, ValueError):
        return (part.get_payload(decode=True) or b"").decode("utf-8", "replace")


def read_eml(raw: bytes) -> dict:
    """Headers, body and attachments with their bytes. The last plain part is the body; html only while the body is blank."""
    message = email.message_from_bytes(raw, policy=policy.default)
    body, names = "", []
    for part in message.walk():
        if part.is_multipart():
            continue
        if part.get_filename():
            names.append({"name": safe(part.get_filename()), "content": part.get_payload(decode=True) or b""})
        elif part.get_content_type() == "text/plain":
            body = content_of(part)
        elif part.get_content_type() == "text/html" and not body.strip():
            body = html_text(content_of(part))
    head = lambda name: str(message.get(name) or "")
    return {"type": "email", "body": body.strip(), "sender": head("From"), "recipient": head("To"), "subject": head("Subject"), "sent": head("Date"), "attachments": names}


def read_msg(raw: bytes) -> dict:
    """All empty where the library for this format is not installed or cannot read the file."""
    try:
        import extract_msg
    except ImportError:
        return nothing("email")
    try:
        message = extract_msg.openMsg(raw)
    except Exception:  # noqa: BLE001  a broken file is an empty mail
        return nothing("email")
    return {"type": "email", "body": message.body or "", "sender": message.sender or "", "recipient": message.to or "", "subject": message.subject or "", "sent": str(message.date or ""), "attachments": [{"name": safe(a.longFilename or a.shortFilename or ""), "content": a.data if isinstance(a.data, bytes) else b""} for a in message.attachments]}


def read_mails(files: DataFrame) -> DataFrame:
    """path and the mail's fields, by the file's ending; other files give type unknown and nothing else."""
    def run(frames):
        for frame in frames:
            rows = [(read_eml if e == "eml" else read_msg if e == "msg" else lambda raw: nothing("unknown"))(bytes(c)) for e, c in zip(frame["ending"], frame["content"], strict=True)]
            yield pd.concat([frame[["path"]].reset_index(drop=True), pd.DataFrame(rows, columns=[f.split()[0] for f in FIELDS.split(", ")])], axis=1)

    return files.select("path", ending(F.col("path")).alias("ending"), "content").mapInPandas(run, f"path string, {FIELDS}")


def attachments(mails: DataFrame) -> DataFrame:
    """One row per attachment, with the columns that files have, so that it can be routed like one. The claim is the
    mail's where it has one, else it follows from the attachment's content."""
    each = mails.select(F.col("path").alias("mail"), F.col("claim_id").alias("_claim") if "claim_id" in mails.columns else F.lit(None).cast("string").alias("_claim"), F.posexplode("attachments").alias("nth", "a"))
    made = each.select("mail", F.concat("mail", F.lit("/"), F.col("nth").cast("string"), F.lit("/"), F.col("a.name")).alias("path"), F.col("a.name").alias("original_name"), F.length("a.content").cast("long").alias("size"), F.col("a.content").alias("content"), F.sha2("a.content", 256).alias("sha256"), "_claim")
    return made.withColumn("claim_id", F.coalesce("_claim", F.concat(F.lit("claim_"), F.substring("sha256", 1, 8)))).drop("_claim")
