"""Folders of the driver's tables, for test modules of every folder (conftest modules shadow one another)."""

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"
