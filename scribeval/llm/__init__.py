"""Operators of a training-data pipeline (see README): each module holds one
operator with a general interface; ``queries`` binds them to the registered
``opN_<name>`` queries.  Nothing outside this subpackage imports it."""
