"""Exceptions by category; all are ValueErrors, so that callers may catch either."""

from __future__ import annotations

from enum import Enum


class Category(Enum):
    SCHEMA = "schema"
    COLUMN = "column"
    TYPE = "type"
    ARGUMENT = "argument"
    SOURCE = "source"


class BrindleError(ValueError):
    category = Category.ARGUMENT


class SchemaError(BrindleError):
    category = Category.SCHEMA


class ColumnError(BrindleError):
    category = Category.COLUMN


class TypeMismatch(BrindleError):
    category = Category.TYPE


class SourceError(BrindleError):
    category = Category.SOURCE
