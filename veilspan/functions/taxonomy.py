"""Kinds, categories and their aliases."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds of each category.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "identity": (
        "person", "nationality", "employee_id",
    ),
    "contact": (
        "email", "phone", "phone_us", "phone_intl", "location", "url", "ip_address", "ip_v4", "ip_v6",
    ),
    "government_id": (
        "ssn",
    ),
    "financial": (
        "credit_card", "iban",
    ),
    "medical": (
        "medical_license",
    ),
    "temporal": (
        "date_time",
    ),
    "credential": (
        "password", "secret_assignment", "bearer_token", "basic_auth", "jwt", "generic_api_key",
    ),
    "cloud_credential": (
        "aws_access_key", "aws_secret_key", "aws_session_token", "gcp_service_account", "gcp_api_key", "azure_storage_key", "azure_connection_string",
    ),
    "vendor_api_key": (
        "openai_api_key", "anthropic_api_key", "github_token", "gitlab_token", "slack_token", "slack_webhook", "stripe_key", "twilio_key",
        "sendgrid_key", "mailgun_key", "npm_token", "pypi_token", "heroku_api_key",
    ),
    "private_key": (
        "private_key_pem", "ssh_private_key", "pgp_private_key",
    ),
    "infrastructure": (
        "connection_string", "hostname_internal",
    ),
}
ALIASES: dict[str, tuple[str, ...]] = {
    "all": tuple(CATEGORIES),
    "pii": ("identity", "contact", "government_id", "financial", "medical", "temporal",),
    "secret": ("credential", "cloud_credential", "vendor_api_key", "private_key",),
    "org_identifier": ("infrastructure",),
    "customer_name": ("identity",),
}
UNKNOWN = "unknown"
CATEGORY_OF: dict[str, str] = {k: c for c, kinds in CATEGORIES.items() for k in kinds}
DEFAULT_POLICY = ("pii", "secret", "org_identifier", "customer_name")


def resolve(names) -> set[str]:
    """Categories that the names stand for; a name that is no alias stands for itself."""
    return set(chain.from_iterable(ALIASES.get(n, (n,)) for n in names))


def category(kind: Column) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(c)) for k, c in CATEGORY_OF.items()))
    return F.coalesce(F.try_element_at(table, kind), F.lit(UNKNOWN))


def allowed(kind: Column, policy) -> Column:
    return category(kind).isin(*sorted(resolve(policy)))


def kind_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, c, i) for i, (k, c) in enumerate(CATEGORY_OF.items())], "kind string, category string, ord int")
