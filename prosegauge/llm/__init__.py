"""Training-data operators: ten corpus stages that nothing else in the library imports.

Each module holds one operator with its general interface; ``queries`` binds
them to the fixed ``opN_<name>`` contracts and ``components`` holds the
connected-components step shared by the near-duplicate operators.
"""
