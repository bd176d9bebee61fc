"""Training-data operators.

Every module holds one operator with a general DataFrame interface;
``queries`` registers the thin ``opN_<name>`` queries over the test tables.
Nothing outside this subpackage imports it.
"""
