"""The four commands as plans over the operators, and the registered queries."""
