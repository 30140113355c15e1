"""The compact query front end and the registered queries."""
