"""Column functions: built-in expressions in text.py and ids.py, scanners of nested groups in scan.py."""
