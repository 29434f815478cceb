"""Roles, and a log formatter that masks personal data. Both run on the driver or as a small join."""

from __future__ import annotations

import logging
import re

from pyspark.sql import Column, DataFrame, functions as F

from adjudica import settings as S


def has_role(role: Column, wanted: str) -> Column:
    """An admin has every role; an unknown user none."""
    if wanted not in S.ROLES:
        raise ValueError(f"unknown role: {wanted}")
    return F.coalesce((role == "admin") | (role == wanted), F.lit(False))


def with_access(df: DataFrame, users: DataFrame, wanted: str, user_col: str = "username", out: str = "allowed") -> DataFrame:
    """Adds whether each row's user has the role."""
    roles = users.select(F.col("username").alias("_user"), F.col("role").alias("_role"))
    return df.join(roles, F.col(user_col) == F.col("_user"), "left").withColumn(out, has_role(F.col("_role"), wanted)).drop("_user", "_role")


def add_user(users: DataFrame, username: str, role: str) -> DataFrame:
    if role not in S.ROLES:
        raise ValueError(f"unknown role: {role}")
    return remove_user(users, username).unionByName(users.sparkSession.createDataFrame([(username, role)], "username string, role string"))


def remove_user(users: DataFrame, username: str) -> DataFrame:
    return users.filter(F.col("username") != username)


class MaskingFormatter(logging.Formatter):
    """Masks addresses and telephone numbers in messages and extras."""

    def format(self, record: logging.LogRecord) -> str:
        out = re.sub(S.MASK_EMAIL, lambda m: f"{m[1][: max(1, min(3, len(m[1]) // 2))]}***@{m[2]}", super().format(record))
        return re.sub(S.MASK_PHONE.removeprefix("(?U)"), lambda m: f"{m[0][:2]}******{m[0][-2:]}", out)


def masked_logger(name: str) -> logging.Logger:
    """The logger with one masking handler, however often it is asked for."""
    logger = logging.getLogger(name)
    if not any(isinstance(h.formatter, MaskingFormatter) for h in logger.handlers):
        handler = logging.StreamHandler()
        handler.setFormatter(MaskingFormatter("%(levelname)s %(name)s %(message)s"))
        logger.addHandler(handler)
    return logger
