"""Constants and source records that several test files use."""

import datetime as dt
import json
from pathlib import Path

TESTDATA = Path("/root/testdata")
RUN_AT = dt.datetime(2025, 6, 30, 8, 0, tzinfo=dt.timezone.utc)

CUSTOMERS = """customer_id,id_number,first_name,last_name,dob,gender,province,income_band,segment,risk_score,kyc_status,product_flags
c1,****1,A,B,1960-06-30,F,gauteng,LOW,MASS,5,VERIFIED,HL|CC
c2,****2,C,D,1999-07-01,M, Western  Cape ,HIGH,PRIVATE,11,PENDING,SA
c2,****2,C,D,1999-07-01,M, Western  Cape ,HIGH,PRIVATE,11,PENDING,SA
c3,****3,E,F,2010-01-01,NB,KwaZulu-Natal,LOW,MASS,abc,FAILED,
,****4,G,H,1980-01-01,F,Limpopo,LOW,MASS,4,VERIFIED,
,****5,I,J,1980-01-01,F,Limpopo,LOW,MASS,4,VERIFIED,
"""

ACCOUNTS = """account_id,customer_ref,account_type,account_status,open_date,product_tier,mobile_number,digital_channel,credit_limit,current_balance,last_activity_date
a1,c1,SAVINGS,ACTIVE,2020-01-01,BASIC,,APP,,10.505,2025-01-02
a2,c2,CREDIT,DORMANT,2021-01-01,PREMIUM,+27,WEB,15000.00,-3.5,03/02/2025
a3,c9,SAVINGS,ACTIVE,2020-01-01,BASIC,,APP,,1.00,
,c1,SAVINGS,ACTIVE,2020-01-01,BASIC,,APP,,1.00,2025-01-02
"""


def tx(tid, **over):
    row = {
        "transaction_id": tid,
        "account_id": "a1",
        "transaction_date": "2025-03-22",
        "transaction_time": "14:37:05",
        "transaction_type": "DEBIT",
        "merchant_category": "GROCERY",
        "amount": 349.5,
        "currency": "ZAR",
        "channel": "POS",
        "location": {"province": "Gauteng", "city": "Sandton", "coordinates": None},
        "metadata": {"device_id": None, "session_id": None, "retry_flag": False},
    }
    row.update(over)
    return json.dumps({k: v for k, v in row.items() if v != "__absent__"})


TRANSACTIONS = [
    tx("t01"),
    tx("t02", transaction_time="10:00:00", channel="APP"),
    tx("t02", transaction_time="09:00:00", channel="ATM"),
    tx("t02", transaction_time="11:00:00", channel="EFT"),
    tx("t03", currency=None),
    tx("t04", currency="R"),
    tx("t05", currency="rands"),
    tx("t06", currency="710"),
    tx("t07", amount=349.505),
    tx("t08").replace("349.5", "1e3"),
    tx("t09", amount="349.505"),
    tx("t10", amount=" 12.5 "),
    tx("t11", amount="abc"),
    tx("t12").replace("349.5", "1" * 20),
    tx("t13", transaction_date="22/03/2025"),
    tx("t14", transaction_date="2025-3-2"),
    tx("t15", transaction_date=""),
    tx("t16", transaction_time=None),
    tx("t17", account_id="a9"),
    tx("t18", account_id=None),
    tx("t19", channel="FAX"),
    tx("t20", currency="R", channel="FAX", transaction_time=None),
    tx("t21", location="__absent__"),
    tx("t22", account_id="a3"),
    tx("t23", account_id="a2", amount="abc", transaction_time="08:00:00"),
    tx("t23", account_id="a2", amount=7),
    tx(None),
    tx(None),
    '{"transaction_id": "t99", broken',
]
