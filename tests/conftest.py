import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerloom.schemas import PRICES, TRANSACTIONS
from ledgerloom.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def d(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="session")
def make_ledger(spark):
    """Ledger from (date, asset, action, quantity[, price, fees, currency, fee_currency]) of one account."""

    def make(rows, account="main"):
        out = []
        for i, row in enumerate(rows, 1):
            date, asset, action, quantity, *rest = row
            price, fees, currency, fee_currency = (list(rest) + [None, None, "USD", None][len(rest):])[:4]
            out.append(
                (account, i, d(date), asset, action, float(quantity), None if price is None else float(price),
                 currency, None if fees is None else float(fees), fee_currency, "broker", None)
            )
        return spark.createDataFrame(out, TRANSACTIONS)

    return make


@pytest.fixture(scope="session")
def make_prices(spark):
    def make(rows):
        return spark.createDataFrame([(t, d(x), float(p)) for t, x, p in rows], PRICES)

    return make


@pytest.fixture(scope="session")
def no_metadata(spark):
    from ledgerloom.schemas import METADATA

    return spark.createDataFrame([], METADATA)
