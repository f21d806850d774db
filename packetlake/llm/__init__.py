"""Operators of a training-data pipeline over documents, pages and vectors."""

from packetlake.session import ship_package

ship_package()
