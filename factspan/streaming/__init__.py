"""No query of this library is a stream: facts come from finished trees and tables, and versions are compared whole."""
