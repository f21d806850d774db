"""Literal packets for the tests."""

import datetime

from packetlake.schemas import PACKET_MESSAGE_SCHEMA

START = datetime.datetime(2026, 4, 20, 8, 0, 0)


def packet(number, seconds, src="10.0.0.1", dst="10.0.0.2", sport=12345, dport=443,
           protocol="TCP", size=100, flags=None):
    at = START + datetime.timedelta(seconds=seconds)
    return (number, at, src, dst, sport, dport, protocol, size, flags)


def packets(spark, rows):
    return spark.createDataFrame(rows, PACKET_MESSAGE_SCHEMA)
